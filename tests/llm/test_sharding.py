import random
import zlib

from gridwx.llm import sharding
from tests.llm.helpers import hard_rows, table


def test_differencing_beats_greedy():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 10_000) for _ in range(500)]
    final = sharding.differencing([[s] + [0] * 15 for s in sizes], 16)
    sums = [0] * 16
    for s, shard in zip(sizes, final):
        assert sorted(shard) == list(range(16))
        sums[shard[0]] += s
    assert max(sums) - min(sums) <= 50
    greedy = [0] * 16
    for s in sorted(sizes, reverse=True):
        k = greedy.index(min(greedy))
        greedy[k] += s
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert sharding.differencing([], 16) == [] and sharding.differencing([[3, 1]], 2) == [[0, 1]]


def test_shards_and_slots(spark):
    rng = random.Random(2)
    rows = hard_rows() + [(1000 + i, "y" * rng.randrange(2000)) for i in range(600)] + [(None, "no id")]
    for chunk in (sharding.CHUNK_GROUPS, 25):
        found = sharding.shard_documents(table(spark, rows), 4, chunk, 50).collect()
        assert len(found) == len(rows)
        texts = dict(rows)
        by_text, slots, sums = {}, {}, {}
        for r in found:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
            by_text.setdefault(raw, set()).add(r["shard"])
            slots.setdefault(r["shard"], []).append(r["slot"])
            sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        assert all(len(s) == 1 for s in by_text.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(len(t) for t in by_text)
        spread = max(sums.values()) - min(sums.values())  # chunks of few groups cannot make up for the largest one
        assert set(slots) == set(range(4)) and spread < (20 if chunk == sharding.CHUNK_GROUPS else largest)


def test_empty_table(spark):
    assert sharding.shard_documents(table(spark, [(1, "a")]).limit(0)).count() == 0
