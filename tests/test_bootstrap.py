import hashlib

import numpy as np
import pytest

from flowlens.operators import metrics as M

SCHEMA = "g long, label int, p double, a double"


def table(seed=3, groups=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(int(rng.integers(1, 9))):
            y = int(g % 2) if g < 3 else int(rng.integers(0, 2))
            rows.append((g * 7, y, round(float(rng.random()), 1), round(float(rng.random() * 0.5 + 0.4 * y), 1)))
    return rows


def plain(rows, column, threshold, picked):
    """By resampled rows, one draw."""
    y, s = (np.concatenate([[r[i] for r in rows if r[0] == g] for g in picked]) for i in (1, column))
    hit, p, n = s >= threshold, int((y == 1).sum()), int((y == 0).sum())
    tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
    fn, tn = p - tp, n - fp
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    f0 = 2 * tn / (2 * tn + fp + fn) if 2 * tn + fp + fn else 0.0
    ap = sum(((s == v) & (y == 1)).sum() * ((s >= v) & (y == 1)).sum() / (s >= v).sum() for v in set(s))
    wins = sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0])
    root = np.sqrt(float(tp + fp)) * np.sqrt(float(p)) * np.sqrt(float(n)) * np.sqrt(float(tn + fn))
    return {
        "recall": tp / p if p else None, "f1": f1 if p else None, "macro_f1": (f1 + f0) / 2 if p and n else None, "pr_auc": ap / p if p and n else None, "fpr": fp / n if n else None, "precision": tp / (tp + fp) if tp + fp else 0.0,
        "specificity": tn / n if n else None, "fnr": fn / p if p else None, "accuracy": (tp + tn) / (p + n), "balanced_accuracy": (tp / p + tn / n) / 2 if p and n else None, "mcc": (tp * tn - fp * fn) / root if root else 0.0,
        "roc_auc": wins / (p * n) if p and n else None, "weighted_f1": (f1 * p + f0 * n) / (p + n),
    }


def test_same_as_resampling_rows(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    groups = sorted({r[0] for r in rows})
    draws = [[groups[int(hashlib.sha256(f"11:{d}:{k}".encode()).hexdigest()[:13], 16) % len(groups)] for k in range(len(groups))] for d in range(1000)]
    values = {mode: [plain(rows, i, 0.5, picked) for picked in draws] for mode, i in (("p", 2), ("a", 3))}
    got = {(r["mode"], r["metric"]): r for r in M.group_bootstrap(df, "g", {"p": 0.5, "a": 0.5}, 1000, 11, base="a").collect()}
    assert len(got) == 39
    for m in M.BOOTSTRAPPED:
        pairs = [(x[m], y[m]) for x, y in zip(values["p"], values["a"], strict=True)]
        for mode, found in (("p", [x for x, _ in pairs]), ("a", [y for _, y in pairs]), ("p-a", [x - y if x is not None and y is not None else None for x, y in pairs])):
            known, r = [v for v in found if v is not None], got[mode, m]
            assert (r["draws"], r["failed"]) == (len(known), 1000 - len(known))
            assert [r["lo"], r["hi"]] == pytest.approx(list(np.percentile(known, [2.5, 97.5])), abs=1e-9), (mode, m)
    assert any(r["failed"] for r in got.values())


def test_too_few_draws(spark):
    with pytest.raises(ValueError, match="1,000"):
        M.group_bootstrap(spark.createDataFrame(table(), SCHEMA), "g", {"p": 0.5}, 10, 1)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    """Cells meet draws in blocks of groups, dealt by scores, with groups that no draw has and scores that are null."""
    rows = table(5, 9) + [(70, 1, None, 0.5), (70, 0, 0.2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(tuple(r) for r in M.group_bootstrap(df, "g", {"p": 0.5, "a": 0.5}, 1000, 11, base="a").collect())
    groups = M.numbered_groups(df, "g")
    picks = spark.createDataFrame([(0, 0), (0, 0), (0, 3), (1, 9)], "draw int, k long")
    for sizes in ((2048, 4096, 1024), (2, 3, 2)):
        for name, n in zip(("DRAWN_GROUPS", "DRAWN_SCORES", "DRAWN_CELLS"), sizes, strict=True):
            monkeypatch.setattr(M, name, n)
        got = {(r["draw"], r["mode"]): r for r in M.draw_metrics(df, "g", {"p": 0.5}, groups, picks, 2).collect()}
        want = plain(rows[:-2], 2, 0.5, [0, 0, 21])
        assert {k: got[0, "p"][k] for k in want} == pytest.approx(want, abs=1e-9)
        # a missing score is no hit
        assert (got[1, "p"]["recall"], got[1, "p"]["fpr"], got[1, "p"]["accuracy"]) == (0.0, 0.0, 0.5)
    assert sorted(tuple(r) for r in M.group_bootstrap(df, "g", {"p": 0.5, "a": 0.5}, 1000, 11, base="a").collect()) == whole
