"""One common line in differing surroundings: no key gathers a passage from each document that holds it."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import repeats

SIZES = {"words": (True, 20, 8, True, repeats.factored, repeats._finish_words), "bytes": (False, 200, 56, False, repeats.suffix_sorted, repeats._finish_bytes)}
PER_SHARD = 2000


def shards(kind, n):
    """Documents of random text around one line, as shards."""
    gen = np.random.default_rng(7)
    word = lambda k: b" ".join(b"%x" % x for x in gen.integers(0, 2**40, k))
    line = word(25) if kind == "words" else word(40)[:230]
    around = (lambda: word(22)) if kind == "words" else (lambda: word(20)[:190])
    for at in range(0, n, PER_SHARD):
        ids = list(range(at, at + PER_SHARD))
        texts = [around() + b" " + line + b" " + around() for _ in ids]
        yield pa.table({"shard": pa.array([at // PER_SHARD] * PER_SHARD, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "seq": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})


def grouped(tables, by):
    whole = pa.concat_tables(tables)
    values = whole.column(by).to_numpy()
    return {int(v): whole.filter(pa.array(values == v)) for v in np.unique(values)}


def steps(kind, n):
    """The largest key's passages, and the removed windows, of all shards."""
    words, size, gram, first, decide, finish = SIZES[kind]
    plan = repeats.Plan(words, size, gram, first, 8, decide, finish, repeats.VARIANTS, repeats.UNSPLIT, repeats.CHUNK_BYTES)
    docs = dict(enumerate(shards(kind, n)))
    none = repeats._table(repeats._KNOWN, [], [], [])
    known = grouped([plan.judge(t) for t in grouped([plan.announce(t) for t in docs.values()], "bin").values()], "shard")
    hot = {k: known[k].filter(pa.array(known[k].column("split").to_numpy() == repeats.SPLIT)) if k in known else none for k in docs}
    windows = grouped([plan.judge_windows(t) for t in grouped([plan.announce_windows(docs[k], hot[k]) for k in docs], "bin").values()], "shard")
    passages = [plan.compare(docs[k], pa.concat_tables([known.get(k, none), windows.get(k, none)])) for k in docs]
    keys = collections.Counter()
    for t in passages:
        own = t.column("own").to_numpy(zero_copy_only=False)
        keys.update(t.column("gram").to_numpy()[~own].tolist())
    ranges = grouped([plan.settle(t) for t in grouped(passages, "bin").values()], "shard")
    out = pa.concat_tables([plan.conclude(docs[k], ranges.get(k, repeats._table(repeats._RANGE, [], [], [], []))) for k in docs])
    return max(keys.values(), default=0), out


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_the_largest_key_does_not_grow_with_documents(kind):
    largest = {}
    for n in (6000, 12000, 24000):
        largest[n], out = steps(kind, n)
        removed = out.column("n_removed").to_numpy()
        if kind == "words":
            assert removed[0] == 0 and (removed[1:] == 25).all()
        else:
            # some neighbours agree in a few characters beyond the line
            assert (removed >= 230).all() and (removed <= 245).all() and (out.column("n_spans").to_numpy() == 1).all()
    assert max(largest.values()) <= repeats.UNSPLIT, largest
