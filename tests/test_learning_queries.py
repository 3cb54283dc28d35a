"""Model queries hand the full settings to the operators; the operators themselves are stubbed, since full fits take minutes."""

import inspect

import pytest

from freightlens.catalog import learning
from freightlens.operators import metrics, models, treeshap
from freightlens.plans import ablation

TRIO = {n: models.PRESETS[n] for n in ("gbt_a", "gbt_b", "gbt_c")}


class Nothing:
    def score(self, rows):
        return rows


@pytest.fixture
def calls(monkeypatch):
    """Bound arguments of every operator call, defaults included."""
    seen = []

    def stub(module, name, result):
        signature = inspect.signature(getattr(module, name))

        def record(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append((name, bound.arguments))
            return result(bound.arguments) if callable(result) else result

        monkeypatch.setattr(module, name, record)

    monkeypatch.setattr(learning, "_rows", lambda spark, sf: None)
    monkeypatch.setattr(learning, "_split", lambda rows: (None, None))
    monkeypatch.setattr(metrics, "all_metrics", lambda scored, cut: None)
    for name in ("oof_predictions", "fit_vote", "fit_stacking", "fit"):
        stub(models, name, Nothing())
    stub(models, "random_search", lambda a: (None, [(t, models.draw_settings(a["base"], t, a["seed"], a["space"]), 0.0) for t in range(a["n_trials"])]))
    stub(treeshap, "tree_shap", None)
    return seen


@pytest.mark.parametrize(("name", "operator", "folds"), [("oof_predictions", "oof_predictions", 5), ("soft_vote_trained", "fit_vote", None), ("stacking", "fit_stacking", 5)])
def test_ensembles_use_three_presets(calls, name, operator, folds):
    learning.query.__globals__["QUERIES"][name](None, None)
    (called, arguments), = calls
    assert called == operator and arguments["settings"] == TRIO and arguments.get("n_folds") == folds


def test_search_draws_every_range_thirty_times(spark, calls):
    rows = learning.random_search(spark, None).collect()
    assert [(a["base"], a["n_trials"], a["space"]) for _, a in calls] == [(models.PRESETS[n], 30, s) for n, s in models.SEARCH_SPACES.items()]
    for name, space in models.SEARCH_SPACES.items():
        mine = [r for r in rows if r["model"] == name]
        assert len(mine) == 30 and all(len({r[k] for r in mine}) > 1 for k in space)


@pytest.mark.parametrize(("name", "preset"), [("tree_shap", "gbt_a"), ("tree_shap_forest", "random_forest")])
def test_attributed_models_are_presets(calls, name, preset):
    learning.query.__globals__["QUERIES"][name](None, None)
    assert [n for n, _ in calls] == ["fit", "tree_shap"] and calls[0][1]["settings"] == models.PRESETS[preset]


def test_experiments_start_from_the_defaults():
    assert learning.BASE == ablation.Experiment()
