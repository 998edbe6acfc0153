import itertools
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import hilbert_shards as hs

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("year", T.IntegerType()), ("shard", T.StringType()), ("size", T.StringType()), ("place", T.LongType()))])


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_goes_from_neighbour_to_neighbour(dims, bits):
    """What makes it a Hilbert curve: it meets every cell once, and each step moves by one in one dimension."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    places = hs.curve_index(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(places)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all() and not path[0].any()
    quadrant = path[: 1 << dims * (bits - 1)] >> bits - 1
    assert len({tuple(c) for c in quadrant.tolist()}) == 1


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "same copy", "é" * rng.randint(0, 9), "w " * rng.randint(0, 300)])
        rows.append((rng.choice([i, i, i, None, 3]), text, rng.choice(["en", "en", "de", None, ""]), rng.choice([None, *(f"s{k}" for k in range(9))]), rng.choice([None, 1990, 2000, 2024]), "x", "y", i))
    return rows


def levels(values, bits, key):
    """Level by value: that of its first row, of 2^bits levels over all rows."""
    ordered, out = sorted(values, key=key), {}
    for i, v in enumerate(ordered):
        out.setdefault(v, i * (1 << bits) // len(ordered))
    return out


def brute(rows, shards, law, bits=3):
    size = {i: len((r[1] or "").encode()) + 8 for i, r in enumerate(rows)}
    nulls_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r[1] or "", []).append((r[0] is not None, r[0] or 0, i))
    meta = []
    for r in rows:
        f = min(first[r[1] or ""])[2]
        meta.append((rows[f][2], rows[f][3], size[f]))
    tables = [levels([m[k] for m in meta], bits, nulls_first) for k in range(3)]
    places = hs.curve_index(np.array([[tables[k][m[k]] for k in range(3)] for m in meta]), bits).tolist()
    return size, places


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [0, 5, 400])
def test_assign(spark, law, n):
    rows = rows_of(n, n)
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = hs.assign(docs, shards=7, law=law, dims=("lang", "source", "size"), bits=3).collect()
    assert len(got) == n
    size, places = brute(rows, 7, law) if n else ({}, [])
    want = Counter((r[0], size[i], zlib.crc32((r[1] or "").encode())) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {(law, None)}
    by_shard = {s: sorted((r.slot, r) for r in got if r.shard == s) for s in range(7)}
    assert sum(map(len, by_shard.values())) == n
    assert all([x[0] for x in v] == list(range(len(v))) for v in by_shard.values())
    if not n:
        return
    if law == "rows":
        counts = [len(v) for v in by_shard.values()]
        assert max(counts) - min(counts) <= 1
    else:
        share, most = sum(size.values()) / 7, max(size.values())
        assert all(abs(sum(x.size for _, x in v) - share) <= most for v in by_shard.values())
    order = [r for s in range(7) for _, r in by_shard[s]]
    # along the curve: the places of the order are those of the sorted rows
    of = {}
    for i, r in enumerate(rows):
        of[(zlib.crc32((r[1] or "").encode()), size[i])] = places[i]
    assert [of[r.text_crc32, r.size] for r in order] == sorted(places)
    # equal texts lie side by side
    runs = [k for k, _ in itertools.groupby((r.text_crc32, r.size) for r in order)]
    assert len(runs) == len(set(runs))


def test_partitions_do_not_matter(spark):
    rows = [(i, f"t{i % 40}", "en", f"s{i % 9}", i, "x", "y", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    one, many = (sorted(map(tuple, hs.assign(d).drop("grown_shard").collect())) for d in (docs.coalesce(1), docs.repartition(9)))
    assert one == many


def test_files_are_skipped(spark):
    """Every stored row comes back; a range reads only the shards that can hold it, on every dimension fewer than by one sorted column."""
    rng = random.Random(1)
    rows = [(i, f"text {i}", rng.choice("abcdefgh"), f"s{rng.randint(0, 63):02d}", rng.choice([None, *range(1990, 2022)]), "mine", "y", i) for i in range(3000)]
    rows += [(7, "again", "a", "s01", 2000, "mine", "y", 0)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    path = tempfile.mkdtemp(prefix="spark-") + "/s"
    hs.write_shards(docs, path, shards=32, dims=("source", "year"), bits=4)
    back = hs.read_where(spark, path, {})
    assert sorted(map(str, (r[:8] for r in back.collect()))) == sorted(map(str, rows)) and back.columns == [*docs.columns, "shard_"]
    manifest = spark.read.parquet(f"{path}/manifest")
    counts = [r["rows"] for r in manifest.collect()]
    assert len(counts) == 32 and max(counts) - min(counts) <= 4
    for ranges, keep in (({"source": ("s10", "s13")}, lambda r: "s10" <= r[3] <= "s13"), ({"year": (1999, 2001)}, lambda r: r[4] is not None and 1999 <= r[4] <= 2001), ({"source": (None, "s05"), "year": (2015, None)}, lambda r: r[3] <= "s05" and r[4] is not None and r[4] >= 2015)):
        found = hs.read_where(spark, path, ranges)
        assert sorted(r.place * 10_000 + (r.doc_id or 0) for r in found.collect()) == sorted(r[7] * 10_000 + r[0] for r in rows if keep(r))
        touched = len({f.split("shard_=")[1].split("/")[0] for f in (r[0] for r in found.select(F.input_file_name()).distinct().collect())})
        assert touched <= 14
    empty = tempfile.mkdtemp(prefix="spark-") + "/e"
    hs.write_shards(spark.createDataFrame([], DOCS), empty)
    assert hs.read_where(spark, empty, {}).count() == 0


def test_bad_law(spark):
    with pytest.raises(ValueError, match="law"):
        hs.assign(spark.createDataFrame([], DOCS), law="key")
