import re

from pyspark.sql import functions as F

from freightlens.llm import licenses


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def shingles(text):
    found = words(text)
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


KNOWN = {i: (words(t), shingles(t)) for i, (_, t) in enumerate(licenses.TEMPLATES)}


def by_hand(text):
    """Templates found by sliding a stretch of their own length, and some more, over the text: the best containment at each
    place, less those of which a better one covers half. Without hashes, windows, bands or votes."""
    found, out = words(text), set()
    there = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    shares = {}
    for i, (own, wanted) in KNOWN.items():
        if wanted & set(there):
            for room in (len(own) - 4, len(own) + 4):
                for s in range(max(len(there) - room, 0) + 1):
                    inside = [p for p in range(s, min(s + room, len(there))) if there[p] in wanted]
                    share = len({there[p] for p in inside}) / len(wanted)
                    if share >= licenses.THRESHOLD:
                        shares[i, inside[0], inside[-1] + 5] = max(share, shares.get((i, inside[0], inside[-1] + 5), 0))
    for (i, a, b), share in shares.items():
        if not any(s > share and 2 * (min(b, d) - max(a, c)) >= b - a for (j, c, d), s in shares.items() if j != i):
            out.add(i)
    return out


def test_every_template_in_any_place(spark, make_docs):
    filler = [f"w{i} q{i * 7}" for i in range(60)]
    texts = []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        for shift in (0, 1, 3, 8):
            texts.append(" ".join(filler[:shift]) + " " + notice.upper() + " " + " ".join(filler[shift : shift + i]))
    texts += [None, "", "one two three four", "licensed under nothing at all really", " ".join(filler)]
    docs = make_docs(list(enumerate(texts))).withColumns({"start": F.lit(1), "license": F.lit("x")})
    got = {}
    for r in licenses.find_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
        assert r["license"] == licenses.TEMPLATES[r["template"]][0] and r["containment"] >= licenses.THRESHOLD
    assert got == {i: w for i, t in enumerate(texts) if (w := by_hand(t))}


def test_edited_notice_and_repeats(spark, make_docs):
    long = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    edited = long.replace("copies", "duplicates", 1)
    rows = licenses.find_licenses(make_docs([(1, edited), (2, "Released under the MIT License.\n" * 300), (2, "more"), (None, long)])).collect()
    assert {(r["doc_id"], r["license"]) for r in rows} == {(1, "MIT"), (2, "MIT"), (None, "MIT")}
    assert licenses.find_licenses(make_docs([])).count() == 0
    assert licenses.find_licenses(make_docs([(1, long)]), templates=[("x", "too short")]).count() == 0


def found_in(make_docs, rows):
    got = licenses.find_licenses(make_docs(rows)).collect()
    return sorted((r["doc_id"], r["license"], r["first_word"], r["last_word"], round(r["containment"], 3)) for r in got)


def test_each_occurrence_is_judged_where_it_stands(make_docs):
    by = next(t for n, t in licenses.TEMPLATES if n == "CC-BY-4.0" and len(t) > 40)
    nc = next(t for n, t in licenses.TEMPLATES if n == "CC-BY-NC-4.0" and len(t) > 40)
    filler = " ".join(f"w{i}" for i in range(400))
    edited = nc.replace("License.", "Licence.")
    n = len(words(by))
    rows = found_in(make_docs, [(1, f"{by} {filler} {edited}"), (2, f"{by} {by} {by}"), (3, f"{filler} {nc}")])
    share = round((len(shingles(nc)) - 1) / len(shingles(nc)), 3)
    assert rows == [
        (1, "CC-BY-4.0", 0, n, 1.0), (1, "CC-BY-NC-4.0", n + 400, n + 400 + len(words(nc)) - 1, share),
        *[(2, "CC-BY-4.0", i * n, (i + 1) * n, 1.0) for i in range(3)],
        (3, "CC-BY-NC-4.0", 400, 400 + len(words(nc)), 1.0),
    ]


def test_swapped_parts_said_twice_and_pieces_far_apart(make_docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    w = words(mit)
    swapped = " ".join(w[30:] + w[:30])
    twice = " ".join(w[:40] + w[20:27] + w[40:])
    noted = " ".join(w[:40] + [f"n{i}" for i in range(20)] + w[40:])
    filler = [f"w{i}" for i in range(500)]
    apart = " ".join(w[:30] + filler + w[30:])
    many = " ".join(w * 50)
    rows = found_in(make_docs, [(1, swapped), (2, twice), (3, noted), (4, apart), (5, many)])
    assert [r[:4] for r in rows if r[0] < 4] == [(1, "MIT", 0, len(w)), (2, "MIT", 0, len(w) + 7), (3, "MIT", 0, len(w) + 20)]
    assert [r[2:] for r in rows if r[0] == 5] == [(i * len(w), (i + 1) * len(w), 1.0) for i in range(50)]
    assert not [r for r in rows if r[0] == 4]


def test_rows_without_a_key_are_judged_one_by_one(make_docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    w = words(mit)
    assert not found_in(make_docs, [(None, " ".join(w[:35])), (None, " ".join(w[35:]))])
    rows = licenses.find_licenses(make_docs([(None, mit), (None, "x " + mit), (None, mit)])).collect()
    assert sorted(r["first_word"] for r in rows) == [0, 1]


def test_template_that_repeats_a_shingle(make_docs):
    notice = "a b c d e f g h a b c d e i j k"
    docs = make_docs([(1, notice + " z " + notice), (2, "a b c d e"), (3, "y y y y y y " + notice)])
    rows = licenses.find_licenses(docs, templates=[("x", notice)]).collect()
    assert sorted((r["doc_id"], r["containment"]) for r in rows) == [(1, 1.0), (1, 1.0), (3, 1.0)]


def test_windows_hold_every_place():
    for size in range(1, licenses.PIECE + 1):
        length, step = licenses.window_plan(size)
        for start in range(40):
            assert any(w <= start and start + size <= w + length for w in range(0, 60, step))


def test_query_against_whole_texts(spark, sf):
    from freightlens.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["doc_id"], r["template"]) for r in QUERIES["op7_license_scan"](spark, sf).collect()}
    assert got == {(k, i) for k, t in texts.items() for i in by_hand(t)} and got
