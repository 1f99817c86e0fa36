import random
from itertools import combinations

from lodeline.llm import near_duplicates as nd


def _texts(n=60, seed=3):
    r = random.Random(seed)
    words = [f"w{i:03d}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(40)]
        out.append("".join(base))
        for _ in range(r.randrange(3)):
            edited = list(base)
            for _ in range(r.randrange(1, 4)):
                edited[r.randrange(40)] = r.choice(words)
            out.append("".join(edited))
    return out


def _brute(texts, t=0.65):
    s = [nd.runs(x) for x in texts]
    return {(i, k) for i, k in combinations(range(len(s)), 2) if len(s[i] & s[k]) >= t * len(s[i] | s[k])}


def _ids(n):
    return [f"{i:04d}" for i in range(n)]


def test_pairs_equal_brute_force(spark):
    texts = _texts()
    ids = _ids(len(texts))
    jobs = spark.createDataFrame([(i, None, t) for i, t in zip(ids, texts, strict=True)], "job_id string, title string, description string")
    got = {tuple(r) for r in nd.found_pairs(jobs).collect()}
    assert got == {(ids[a], ids[b]) for a, b in _brute(texts)}


def test_growing_texts_lose_nothing(spark):
    r = random.Random(1)
    base = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300))
    texts = [base[: 200 + i] for i in range(40)]
    jobs = spark.createDataFrame([(i, "t", t) for i, t in zip(_ids(40), texts, strict=True)], "job_id string, title string, description string")
    got = {tuple(x) for x in nd.found_pairs(jobs).collect()}
    assert got == {(_ids(40)[a], _ids(40)[b]) for a, b in _brute(["t" + t for t in texts])}


def test_cases(spark):
    long = "這份工作需要細心負責且守時並能配合輪班" * 3
    rows = [("1", None, long), ("2", "", long), ("3", "x", None), ("4", "x", ""), ("5", "x", "短"), ("6", None, long[:-1]), ("7", None, "完全不同的內容" * 3000), ("8", None, "完全不同的內容" * 3000), ("8", None, "完全不同的內容" * 3000)]
    jobs = spark.createDataFrame([(*r, "c") for r in rows], "job_id string, title string, description string, rep string")
    assert sorted(tuple(r) for r in nd.found_pairs(jobs).collect()) == [("1", "2"), ("1", "6"), ("2", "6"), ("7", "8")]
    classes = {r["job_id"]: (r["class_id"], r["n_links"]) for r in nd.advertisement_classes(jobs).collect()}
    assert classes == {"1": ("1", 1), "2": ("1", 1), "6": ("1", 1), "7": ("7", 0), "8": ("7", 0)}
    assert nd.found_pairs(jobs.limit(0)).count() == 0 and nd.advertisement_classes(jobs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(20)] + [("50", "51")], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:02d}",) for i in [*range(21), 50, 51, 60]], "id string")
    got = {r["id"]: r["component"] for r in nd.components(links, nodes).collect()}
    assert {got[f"{i:02d}"] for i in range(21)} == {"00"} and got["51"] == "50" and got["60"] == "60"


def test_heap_merge_and_probe():
    assert list(nd.heap_merge([[1, 3], [1, 2]])) == [(1, 2), (2, 1), (3, 1)] and list(nd.heap_merge([[4, 7]])) == [(4, 1), (7, 1)]
    assert nd.holds([1, 2, 9], 9) and not nd.holds([1, 2, 9], 5) and not nd.holds([1], None) and not nd.holds([], 1)


def test_missed_pairs_are_rare():
    assert nd.missed(0.75) < 1e-4 and nd.missed(0.70) < 5e-4 and nd.missed(0.2, 20_000) > 0.99


def _met(df):
    return sorted((r["x"], y) for r in df.collect() for y in r["ys"])


def test_lists_in_a_stream_equal_brute_force(spark, monkeypatch):
    """Short and long lists over many small batches; long ones come out as members in blocks, and their meetings complete the pairs."""
    r = random.Random(4)
    rows = [(k, x, r.randrange(10, 40)) for k in range(30) for x in range(1 if k % 3 == 0 else r.choice([2, 5, 300, 700, nd.BLOCK, nd.BLOCK + 1]))]
    size = {}
    rows = [(k, x, size.setdefault(x, n)) for k, x, n in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = nd.lists(spark.createDataFrame(rows, "key long, x long, n int"), 0.65).cache()
        members = found.filter("part >= 0")
        got = sorted(_met(found.filter("part < 0")) + _met(nd.block_meetings(members, 0.65)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {}
    for k, x, _ in rows:
        own.setdefault(k, []).append((size[x], x))
    expected = sorted((a[1], b[1]) for m in own.values() for a, b in combinations(sorted(m), 2) if b[0] * 0.65 <= a[0])
    assert got == expected
    assert members.groupBy("key", "part").count().toPandas()["count"].max() <= nd.BLOCK


def test_long_lists_lose_no_pair(spark, monkeypatch):
    """Records whose keys all have long lists: the set-aside list is made up for by the probe."""
    r = random.Random(2)
    base = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(400))
    texts = [base[: 200 + i % 190] + "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(3)) for i in range(620)]
    sig = nd.signed(spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "rep string, text string")).cache()
    ids = {row["x"]: int(row["rep"]) for row in sig.select("x", "rep").collect()}
    keys = {row["x"]: set(row["keys"]) for row in sig.select("x", "keys").collect()}
    n = {row["x"]: row["n"] for row in sig.select("x", "n").collect()}
    got = {frozenset((row["x"], row["y"])) for row in nd.candidates(sig, 0.65).collect()}
    expected = {frozenset((a, b)) for a, b in combinations(ids, 2) if len(keys[a] & keys[b]) >= nd.T and min(n[a], n[b]) >= 0.65 * max(n[a], n[b])}
    assert got == expected and len(got) > 10_000
