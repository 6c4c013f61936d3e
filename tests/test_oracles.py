"""Every query returns what its SQL returns in DuckDB, on the smallest tables; those without SQL are held against
plain computations of their own."""

import zlib
from datetime import timedelta

import numpy as np
import pytest
from oracle import DATA, compare, connect

import seriesforge.queries as q
from seriesforge.functions import kernels as k
from seriesforge.functions import text as tx

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, con, name):
    assert compare(q.QUERIES[name](spark, SF), con, q.ORACLES[name]) == ""


def rows(spark, name):
    return q.QUERIES[name](spark, SF).collect()


def daily(con, value, by="o_orderpriority", table="orders", ts="o_orderdate", fill=True):
    """by -> (first day, values by day, 0 where there is none)."""
    out = {}
    for key, day, v in con.execute(f"SELECT {by}, {ts}::DATE, {value} FROM {table} GROUP BY 1, 2 ORDER BY 1, 2").fetchall():
        out.setdefault(key, []).append((day, v))
    if not fill:
        return {s: (None, np.array([v for _, v in d], float)) for s, d in out.items()}
    return {s: (d[0][0], np.array([dict(d).get(d[0][0] + timedelta(i), 0.0) for i in range((d[-1][0] - d[0][0]).days + 1)], float)) for s, d in out.items()}


def test_stl_baseline(spark, con):
    got = {}
    for r in rows(spark, "stl_baseline"):
        got.setdefault(r.o_orderpriority, []).append(r)
    for key, (_, y) in daily(con, "sum(o_totalprice)").items():
        part = sorted(got[key], key=lambda r: r.period)
        trend, season, rest = (np.array([r[c] for r in part]) for c in ("trend", "seasonal", "residual"))
        assert np.allclose(trend + season + rest, y, atol=0.05)
        weeks = season[: len(y) // 7 * 7].reshape(-1, 7)
        assert np.quantile(abs(weeks.mean(axis=1)), 0.9) < 0.2 * season.std()  # a season is level over its period, but for the ends
        assert np.allclose(trend, k.mstl(y, [7])[0], atol=0.02)  # whose kernel is tested with planted trends


def direct_points(y, penalty, size):
    """Change points by trying every last segment."""
    n = len(y)
    d = (y[:, None] - y[None, :]) ** 2
    s = np.zeros((n + 1, n + 1))
    s[1:, 1:] = np.exp(-d / np.median(d[np.triu_indices(n, 1)])).cumsum(0).cumsum(1)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for b in range(size, n + 1):
        a = np.arange(0, b - size + 1)
        total = best[a] + (b - a) - (s[b, b] - 2 * s[a, b] + s[a, a]) / (b - a) + penalty
        best[b], last[b] = total.min(), total.argmin()
    out, at = [], n
    while last[at] > 0:
        at = int(last[at])
        out.append(at)
    return out[::-1]


def test_change_points(spark, con):
    got = {}
    for r in rows(spark, "change_points"):
        got.setdefault(r.o_orderpriority, []).append(r)
    price = "avg(o_totalprice * CASE WHEN o_orderdate::DATE >= DATE '1998-07-01' THEN 3 ELSE 1 END)"
    found = 0
    for key, (_, y) in daily(con, price, fill=False).items():
        y = np.round((y - y.mean()) / y.std(), 6)
        want = direct_points(y, np.log(len(y)) * y.var(), max(len(y) // 10, 5))
        part = sorted(got.get(key, []), key=lambda r: r["at"])
        assert [r["at"] for r in part] == want
        assert all(r.magnitude == pytest.approx(y[c : c + 5].mean() - y[c - 5 : c].mean(), abs=1e-3) for r, c in zip(part, want))
        found += len(want)
    assert found >= 5


def test_matrix_profile(spark, con):
    got = {}
    for r in rows(spark, "matrix_profile"):
        got.setdefault(r.o_orderpriority, []).append((r.start, r.score))
    for key, (_, y) in daily(con, "sum(o_totalprice)").items():
        m = max(len(y) // 20, 4)
        windows = np.lib.stride_tricks.sliding_window_view(y, m)
        z = (windows - windows.mean(1, keepdims=True)) / windows.std(1, keepdims=True)
        apart = np.abs(np.subtract.outer(np.arange(len(z)), np.arange(len(z)))) > max(1, m // 4)
        dist = np.where(apart, np.sqrt(np.maximum(0, 2 * m - 2 * (z @ z.T))), np.inf).min(1)
        limit = np.quantile(dist, 0.95)
        found = sorted(got[key])
        assert found and all(dist[s] > limit - 1e-6 and score == pytest.approx(dist[s] / dist.max(), abs=1e-3) for s, score in found)
        assert max(dist[s] for s, _ in found) == pytest.approx(dist.max(), abs=1e-4)
        assert all(b - a >= m for (a, _), (b, _) in zip(found, found[1:]))
        assert all(min(abs(i - s) for s, _ in found) < m for i in np.flatnonzero(dist > limit + 1e-6))  # nothing unusual is left out


def test_detect_deviations(spark, con):
    got = [r for r in rows(spark, "detect_deviations")]
    assert {r.kind for r in got} >= {"point_anomaly"} and {r.column for r in got} == {"o_totalprice"}
    for key, (first, y) in daily(con, "sum(o_totalprice)").items():
        part = [r for r in got if r.segment_id == key]
        at = len(y) - 91
        assert all(r["at"] >= at and r.ts.date() == first + timedelta(r["at"]) for r in part)
        rest = k.mstl(y, [7, 365])[2]
        recent, w = y[at:], len(y[at:]) // 10
        half = w // 2
        smooth = np.array([recent[i - half : i - half + w].mean() if half <= i <= len(recent) - w + half else np.nan for i in range(len(recent))])
        known = np.flatnonzero(~np.isnan(smooth))
        smooth = np.array([smooth[known[known <= i][-1]] if (known <= i).any() else smooth[known[0]] for i in range(len(recent))])
        z = np.abs(recent - smooth) / rest.std()
        want = {at + i for i in np.flatnonzero(z > 2.5)}
        assert {r["at"] for r in part if r.kind == "point_anomaly"} <= want
        assert want <= {r["at"] for r in part}  # at one place the most severe stays


def test_batch_run(spark, con):
    got = {r.segment_id: r for r in rows(spark, "batch_run")}
    series = daily(con, "sum(value)", "event_type", "events", "ts")
    assert set(got) == {f"seg_events_{key}" for key in series}
    for key, (_, y) in series.items():
        r = got[f"seg_events_{key}"]
        rest = k.mstl(y, [7, 365])[2]
        assert (r.n, r.error, r.scenario) == (len(y), None, "by_type") and r.variance_explained == pytest.approx(max(0, 1 - rest.var(ddof=1) / y.var(ddof=1)), abs=1e-4)


def test_trend_fallback(spark):
    got = rows(spark, "trend_fallback")
    assert got and all(r.seasonal == 0 and r.trend + r.residual == pytest.approx(r.v, abs=0.05) for r in got)


def names_of(con, sql):
    return sorted(r[0] for r in con.execute(sql).fetchall())


def test_fuzzy_pairs(spark, con):
    names = names_of(con, "SELECT DISTINCT p_name FROM part")
    want = {(a, b): tx.token_sort_ratio(a.lower(), b.lower()) for i, a in enumerate(names) for b in names[i + 1 :]}
    got = {(r.a, r.b): r.score for r in rows(spark, "fuzzy_pairs")}
    assert got == {p: pytest.approx(s) for p, s in want.items() if s >= 82.0}
    assert tx.token_sort_ratio("blue bolt", "bolt blue") == 100 and tx.token_sort_ratio("abcd", "abxd") == 75.0


def test_fuzzy_clusters(spark):
    got = sorted(rows(spark, "fuzzy_clusters"), key=lambda r: r.raw)
    heads, want = [], []
    for r in got:
        at = next((i for i, h in enumerate(heads) if tx.token_sort_ratio(h, r.normalized) >= 80.0), None)
        if at is None:
            at = len(heads)
            heads.append(r.normalized)
        want.append(at)
    assert [r.cluster for r in got] == want and len(heads) > 1
    for c in set(want):
        part = [r for r in got if r.cluster == c]
        texts = sorted({r.normalized for r in part})
        pairs = [tx.token_sort_ratio(a, b) for i, a in enumerate(texts) for b in texts[:i]]
        assert {r.confidence for r in part} == {round(sum(pairs) / len(pairs) / 100, 3) if pairs else 1.0}
        assert len({r.canonical for r in part}) == 1 and part[0].canonical in {r.raw for r in part}


def test_kmeans_pca(spark, con):
    vec = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    got = {r.vec_id: r for r in rows(spark, "kmeans_pca")}
    assert set(got) == set(vec) and len({r.cluster for r in got.values()}) == 4
    x = {i: np.array(v, float) for i, v in vec.items()}
    centre = {c: np.mean([x[i] for i, r in got.items() if r.cluster == c], axis=0) for c in range(4)}
    for i, r in got.items():
        assert r.size == sum(o.cluster == r.cluster for o in got.values())
    moved = sum(min(centre, key=lambda c: ((x[i] - centre[c]) ** 2).sum()) != r.cluster for i, r in got.items())
    assert moved <= 0.02 * len(got)  # each row is with the nearest mean, but for the last step


def test_text_search(spark, con):
    def embed(t):
        v = np.zeros(384)
        for word in t.lower().split():
            h = zlib.crc32(word.encode())
            v[h % 384] += 1 if h >> 31 else -1
        return v / (np.linalg.norm(v) or 1)

    want = embed("red steel")
    likes = sorted(((-float(embed(f"{n} {t}") @ want), i) for i, n, t in con.execute("SELECT p_partkey, p_name, p_type FROM part").fetchall()))
    got = sorted(((-r.similarity, r.p_partkey) for r in rows(spark, "text_search")))
    assert [i for _, i in got] == [i for _, i in likes[:10]] and np.allclose([s for s, _ in got], [s for s, _ in likes[:10]], atol=1e-5)


def test_every_query_is_checked():
    done = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert set(q.QUERIES) - set(q.ORACLES) <= done
