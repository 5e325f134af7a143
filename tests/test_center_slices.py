"""F3 to F7: above the broadcast bound every token met its vector by a shuffle."""

import numpy as np
import pytest

from vecfactor.operators import centers as C
from vecfactor.operators.center_slices import list_sums, write_lists


@pytest.fixture()
def small_bound(spark):
    spark.conf.set("vecfactor.broadcast.maxBytes", "200")
    yield
    spark.conf.unset("vecfactor.broadcast.maxBytes")


def _inputs(spark):
    rng = np.random.default_rng(5)
    vecs = {f"w{i}": [float(x) for x in rng.normal(size=3).astype("float32")] for i in range(40)}
    vecs["w3"] = None                                    # known, adds nothing
    vecs["w4"] = [None, 1.0, 2.0]
    rows = [(w, i, v) for i, (w, v) in enumerate(vecs.items())]
    rows += [("w5", 99, [1.0, 1.0, 1.0]), ("w6", None, [2.0, 2.0, 2.0]), (None, 98, [1.0, 1.0, 1.0])]
    vocab = spark.createDataFrame(rows, "word string, word_idx long, vec array<float>")
    own = [(k % 25, [f"w{int(i)}" for i in rng.integers(0, 50, size=int(rng.integers(0, 30)))] + ["the", None])
           for k in range(60)]
    own += [(None, ["w3"]), (None, ["w4"]), (7, None), (8, ["w5", "w5", "w6", "nope"])]
    return spark.createDataFrame(own, "list_id long, words array<string>"), vocab, own, rows


def _want(own, rows):
    out = []
    for lid, words in own:
        n_words = n_known = 0
        total, used = [None] * 3, set()
        for w in words or []:
            if w is None or w == "the":
                continue
            hits = [r for r in rows if r[0] == w]
            n_words += max(1, len(hits))
            for _, i, v in hits:
                n_known += i is not None
                used |= {i} - {None}
                for d in range(3 if v else 0):
                    if v[d] is not None:
                        total[d] = (total[d] or 0.0) + v[d]
        cen = [None if x is None else round(x / n_known, 9) for x in total] if n_known else None
        out.append(str((lid, n_words, n_known, cen, sorted(used))))
    return sorted(out)


def _got(rows):
    return sorted(str((r["list_id"], r["n_words"], r["n_known"], r["center"] and [
        None if x is None else round(x, 9) for x in r["center"]], sorted(r["used"]))) for r in rows)


def test_slices_give_what_a_join_gives(spark, small_bound):
    lists, vocab, own, rows = _inputs(spark)
    out = C.centers(lists, vocab, with_used=True)
    assert _got(out.collect()) == _want(own, rows)
    joined = C.centers(lists, vocab, broadcast=True)
    plain = C.centers(lists, vocab)
    key = lambda r: str((r["list_id"], r["n_words"], r["n_known"],
                         r["center"] and [x if x is None else round(x, 9) for x in r["center"]]))
    assert sorted(map(key, plain.collect())) == sorted(map(key, joined.collect()))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 4      # several slices, no token met its vector by a shuffle


def test_one_row_per_list_and_slice_leaves_a_task(spark, tmpdir_shared):
    vocab = spark.createDataFrame([(f"w{i}", i, [float(i), 1.0]) for i in range(50)],
                                  "word string, word_idx long, vec array<float>")
    lists = spark.createDataFrame([(k, [f"w{(k + i) % 50}" for i in range(400)]) for k in range(30)],
                                  "list_id long, words array<string>")
    parts = list_sums(write_lists(lists, f"{tmpdir_shared}/lists"), vocab, 2, C.vocab_stats(vocab)[2], 700, False)
    n = parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert n > 2 and parts.count() <= 30 * n            # 12,000 tokens
    assert parts.agg({"n_words": "sum"}).first()[0] == parts.agg({"n_known": "sum"}).first()[0] == 12_000


def test_used_centers_leave_no_written_lists(spark, small_bound, tmpdir_shared):
    import glob

    from vecfactor.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    lists, vocab, own, _ = _inputs(spark)
    before = set(glob.glob(f"{base}/vecfactor/lists/*"))
    assert C.centers(lists, vocab, with_used=True).count() == len(own)      # its parts are in their place
    assert set(glob.glob(f"{base}/vecfactor/lists/*")) == before


def test_a_feed_batch_leaves_nothing_but_its_output(spark, small_bound, tmpdir_shared):
    """every parsed request stayed in a checkpoint, twice: as line and as words."""
    import glob
    import json
    import os

    from vecfactor.session import ensure_checkpoint_dir
    from vecfactor.streaming import feeds
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    _, vocab, own, rows = _inputs(spark)
    os.makedirs(f"{tmpdir_shared}/in")
    asked = [(i, w) for i, (_, w) in enumerate(own) if w is not None]
    with open(f"{tmpdir_shared}/in/a.txt", "w") as f:
        f.write("".join(json.dumps({"list_id": i, "words": w}) + "\n" for i, w in asked) + "{oops\n")
    kept = lambda: {x for x in glob.glob(f"{base}/*") + glob.glob(f"{base}/vecfactor/*/*")
                    if not os.path.samefile(x, tmpdir_shared) and not x.endswith("/vecfactor")}
    before = kept()
    feeds.center_feed(spark, f"{tmpdir_shared}/in", vocab, f"{tmpdir_shared}/out",
                      f"{tmpdir_shared}/ckpt").awaitTermination()
    assert not any(glob.glob(f"{x}/**/*.parquet", recursive=True) or glob.glob(f"{x}/rdd-*") for x in kept() - before)
    got = feeds.read_output(spark, f"{tmpdir_shared}/out/centers").collect()
    assert sorted((r["list_id"], r["n_known"]) for r in got) == \
        sorted((i, sum(r[1] is not None for w in ws if w for r in rows if r[0] == w)) for i, ws in asked)
    assert [r["request"] for r in feeds.read_output(spark, f"{tmpdir_shared}/out/rejected").collect()] == ["{oops"]
