import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from freightlens.llm import langid

SAMPLE = {
    "en": "the house and the garden with the small river that was there when we came to the old town",
    "de": "das haus und der garten mit dem kleinen fluss der dort war als wir in die alte stadt kamen",
    "fr": "la maison et le jardin avec la petite riviere qui etait la quand nous sommes venus dans la ville",
}


def corpus(make_docs):
    words = {k: v.split() for k, v in SAMPLE.items()}
    r = np.random.default_rng(1)
    return make_docs([(i, " ".join(r.choice(words[lang], 25)), lang) for i, lang in enumerate(list(SAMPLE) * 40)])


def test_codewords_are_apart():
    for count in (1, 2, 3, 7, 40, 120):
        code = langid.codewords(count, 15)
        assert set(np.unique(code)) <= {-1, 1}
        least = min(((a != b).sum() for a, b in combinations(code, 2)), default=9)
        assert least >= (1 if count == 2 else 3)


def test_predicts_held_out_and_flags(spark, make_docs):
    docs = corpus(make_docs)
    model = langid.learn(spark, docs)
    odd = make_docs([(900, None), (901, ""), (902, "123 !!! 456"), (903, SAMPLE["de"].upper()), (None, SAMPLE["fr"]), (904, "the " * 20_000), (903, SAMPLE["de"])])
    odd = odd.withColumns({"score": F.lit("clash"), "x": F.lit(1)})
    rows = langid.predict(odd, model).collect()
    got = [(r["doc_id"], r["lang_pred"]) for r in rows]
    assert got == [(900, "und"), (901, "und"), (902, "und"), (903, "de"), (None, "fr"), (904, "en"), (903, "de")]
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == 0
    held = langid.predict(docs.where(langid.held_out()), model, keep=["doc_id", "lang"]).collect()
    assert held and all(r["lang"] == r["lang_pred"] for r in held)
    kept = langid.known_only(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 903, 903, 904]


def test_nothing_or_one_language_to_learn(spark, make_docs):
    none = langid.fit(make_docs([(1, "abc", None), (2, None, "en")]))
    assert [r["lang_pred"] for r in langid.predict(make_docs([(1, "abc")]), none).collect()] == ["und"]
    one = langid.fit(make_docs([(1, "abc", "en"), (2, "abd", "en")]))
    assert [tuple(r)[-3:-1] for r in langid.predict(make_docs([(1, "abc"), (2, "1")]), one).collect()] == [("en", 1.0), ("und", 0.0)]
    assert langid.predict(make_docs([]), one).count() == 0


def test_query_on_held_out_documents(spark, sf):
    from freightlens.llm.queries import QUERIES

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, sf).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in lang}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
