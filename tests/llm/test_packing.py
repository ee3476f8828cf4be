from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing


def plain_best_fit(sizes, capacity, open_bins):
    """The same rule with lists: least sufficient space, newest first; the fullest closes."""
    bins, out, made = [], [], 0
    for s in sizes:
        fit = [b for b in bins if b[0] >= s]
        if fit:
            space = min(b[0] for b in fit)
            b = [x for x in bins if x[0] == space][-1]
            bins.remove(b)
        else:
            if len(bins) >= open_bins:
                space = min(x[0] for x in bins)
                bins.remove([x for x in bins if x[0] == space][-1])
            b = [capacity, made]
            made += 1
        b[0] -= s
        out.append(b[1])
        if b[0]:
            bins.append(b)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(1, 5))
def test_best_fit(sizes, k):
    p = packing.BestFit(20, k)
    assert [p.put(s) for s in sizes] == plain_best_fit(sizes, 20, k)


def test_pack(spark):
    sizes = [(i, (i * 37) % 90 + 1, "x") for i in range(500)] + [(1000, 250, "x"), (1001, 0, "x"), (1002, None, "x"), (None, 5, "x"), (7, 11, "x"), (7, 11, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int, container string")
    limits = spark.createDataFrame([("small", 60), ("big", 100), ("none", None), ("zero", 0)], "limit_name string, capacity_tokens int")
    for shard_rows in (50_000, 100):
        got = packing.pack(df, limits, open_bins=16, shard_rows=shard_rows)
        rows = got.collect()
        for name, cap in (("small", 60), ("big", 100)):
            use, per_doc = {}, {}
            for r in rows:
                if r.limit_name == name:
                    use[r.container] = use.get(r.container, 0) + r.tokens
                    per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.tokens
            assert max(use.values()) <= cap and len(per_doc) == 504
            assert sum(per_doc.values()) == sum(t or 0 for _, t, _ in sizes)
        assert {r.piece for r in rows if r.doc_id == 1000 and r.limit_name == "big"} == {0, 1, 2}
        assert all(r.piece == 0 for r in rows if r.limit_name == "big" and r.doc_id != 1000)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, packing.pack(df.repartition(9), limits, 16, shard_rows).collect()), key=str)
    report = {r.limit_name: r for r in packing.fill_report(got, limits).collect()}
    assert report["big"].fill > 0.85 and report["big"].most <= 100
    assert packing.pack(df.limit(0), limits).count() == 0 == packing.pack(df, limits.limit(0)).count()


def test_token_sizes(spark):
    import tiktoken

    df = spark.createDataFrame([(1, "Net income rose. <|endoftext|>", 0), (2, "", 0), (3, None, 0), (4, "word " * 100_000, 0)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in packing.token_sizes(df).collect()}
    assert got[2] == got[3] == 0 and got[1] > 5 and got[4] == 100_001 and tiktoken
