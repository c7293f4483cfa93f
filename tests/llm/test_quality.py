import random
import re
import time

from evidex.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string"


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", " \t", "one", "a b c d e a b c d e", "\x0b\fx\r\ny ## <b>|é ü z", "same line\nsame line\n \n \nsame line"]
    texts += ["abc \u2028", "\x85", "a\u2029 \u2028\n\x85 b\x85", " \x0b\x85\x0c ", "a b c d e f g h i j\n\u2028\n\u2028"]  # line ends that are no white space here
    for _ in range(40):
        words = rng.choices(["a", "b", "é*", "Cc", "d.", "$"], k=rng.randrange(60))
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    rows = [(i, t, rng.choice(["en", None]), "s") for i, t in enumerate(texts)]
    got = Q.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == {i: slow_base(t) for i, t, *_ in rows}
    assert all(r.kept == (not r.base_failed) for r in got)


def test_long_white_space_takes_its_length(spark):
    """A run of a million blanks, inside a text and at both ends."""
    text = " " * 1_000_000 + "a" + "\n\t " * 300_000 + "b" + " " * 1_000_000
    start = time.perf_counter()
    (row,) = Q.judged(spark.createDataFrame([(1, text, "en", "s")], SCHEMA)).collect()
    assert (row.n_words, row.word_chars, row.base_failed) == (2, 2, True)
    assert time.perf_counter() - start < 60


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, prose(rng, rng.randrange(20, 300), vocab), "en", f"s{i % 2}") for i in range(300)]
    bad = [(1000 + i, prose(rng, 100, vocab).upper().replace(" ", "!! "), "en", "s0") for i in range(25)]
    frame = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS d2", "3 AS _row", "4 AS g", "5 AS _q_words", "6 AS x0")
    kept = {r.doc_id for r in Q.judged(frame).filter("kept").collect()}
    assert kept == {r[0] for r in rows}
    left = Q.keep_good(frame)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == kept


def plain_mcd(x, share=Q.SHARE):
    """FAST-MCD in numpy from the same six starts: (centre, scatter with consistency factor and floors, log determinant)."""
    import numpy as np

    floor = np.array([*Q.FLOORS.values()])

    def floored(c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), floor**2))
        return c

    def step(m, c):
        d = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
        near = x[np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]]
        raw = np.cov(near.T, bias=True)
        return near.mean(0), floored(raw), raw, np.linalg.slogdet(floored(raw))[1]

    m = np.median(x, axis=0)
    u = np.maximum(1.4826 * np.median(abs(x - m), axis=0), floor)
    z = (x - m) / u
    norm = (z * z).sum(1)
    made = [np.clip(z, -2, 2), np.tanh(z), z / np.sqrt(norm)[:, None], z[norm <= np.median(norm)], z[(abs(z) <= 2.5).all(1)]]
    scatters = [np.cov(v.T, bias=True) * np.outer(u, u) for v in made] + [np.diag(u**2)]
    now = [(m, floored(c), c, np.inf) for c in scatters]
    for _ in range(Q.FIRST_STEPS):
        now = [step(*s[:2]) for s in now]
    ends = []
    for s in sorted(now, key=lambda s: s[3])[: Q.BEST]:
        while (after := step(*s[:2]))[3] < s[3]:
            s = after
        ends.append(s)
    m, _, raw, ld = min(ends, key=lambda s: s[3])
    return m, floored(Q.consistency(share) * raw), ld


def test_estimate_matches_plain_mcd(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {}
    for g in range(4):
        x = rng.normal(size=(400, Q.DIM)) @ rng.normal(size=(Q.DIM, Q.DIM)) * (1, 1, 0.01, 1)[g] + 5
        if g:  # a cluster of outliers, up to 22 % of the rows
            x[: 30 * g] = rng.normal(size=(30 * g, Q.DIM)) * 0.3 + 20
        groups[f"s{g}"] = x
    frame = spark.createDataFrame([("e", g, *map(float, r)) for g, x in groups.items() for r in x], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(Q.DIM)))
    for share, loose in ((Q.SHARE, 0.12), (1.0, 1e-6)):
        named, model = Q.estimate(frame, share=share)
        rows = {r.source: r for r in named.join(model, "g").collect()}
        for g, x in groups.items():
            row = rows[g]
            factor = np.array([[row[f"l{i}{j}"] if j <= i else 0.0 for j in range(Q.DIM)] for i in range(Q.DIM)])
            m, c, ld = plain_mcd(x, share)
            mine = np.linalg.slogdet(factor @ factor.T)[1]
            assert abs(mine - np.linalg.slogdet(c)[1]) < max(loose, 1e-6) * Q.DIM, (g, share)
            assert np.abs(np.linalg.solve(np.linalg.cholesky(c), np.array([row[f"m{i}"] for i in range(Q.DIM)]) - m)).max() < max(loose, 1e-6) * 2
            far = lambda c_: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c_), x - m)
            if share < 1:
                assert ((far(factor @ factor.T) > Q.CUTOFF) == (far(c) > Q.CUTOFF)).all()
                assert (far(factor @ factor.T) > Q.CUTOFF).sum() >= 30 * int(g[1])


def test_consistency_factor():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200_000, Q.DIM))
    d = (x * x).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert abs(near.var() * Q.consistency(0.75) - 1) < 0.01 and Q.consistency(1.0) == 1


def test_very_long_text_and_repeats(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i % 90, prose(rng, 80, vocab), "en", "s") for i in range(120)] + [(500, prose(rng, 200_000, vocab), "en", "s")] * 2
    got = Q.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 122 and [r.n_words for r in got if r.doc_id == 500] == [200_000] * 2


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Q.judged(none).collect() == [] and Q.keep_good(none).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)
    assert [r.kept for r in Q.judged(nulls).collect()] == [False] * 3
    assert Q.keep_good(spark.createDataFrame([(1, "a b c d e f g h i j k", None, None)] * 2, SCHEMA)).count() == 2
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in Q.judged(nulls)._jdf.queryExecution().toString()]
