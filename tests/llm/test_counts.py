"""Mixing, sharding, line dedup, license scan and decontamination against plain Python, with odd rows."""

import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import decontaminate, licenses, line_dedup, mixing, sharding


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


def test_mix_equals_plain_form(odd, odd_rows):
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies) for r in mixing.with_copies(odd).collect())
    want = Counter((d["doc_id"], n, per, round(goal, 6), copies) for d, n, copies, per, goal in brute.mixed(as_dicts(odd_rows)))
    assert got == want
    assert max(r[4] for r in got) <= 3


def test_mix_emits_copies_and_keeps_columns(spark, odd, odd_rows, empty):
    clash = odd.withColumns({c: F.lit(1) for c in ("size", "goal_source", "mix_rate", "copies", "target")})
    out = mixing.mix(clash)
    assert out.columns == clash.columns
    want = Counter()
    for d, _, copies, _, _ in brute.mixed(as_dicts(odd_rows)):
        want[d["doc_id"], d["text"], d["source"]] += copies
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want
    assert mixing.mix(empty).count() == 0 and mixing.with_copies(empty).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert got == pytest.approx(want) and got["c"] == 15 and sum(got.values()) == pytest.approx(1418)


def test_shards(spark, odd, empty):
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("tie"), F.lit(0).alias("part"))
    rows = sharding.assign_shards(sharding.assign_shards(rows, 4), 5, column="grown")
    got = sharding.with_slots(rows, "shard", ["doc_id", "text"]).collect()
    assert len(got) == 13
    for r in got:
        assert r.shard == brute.shard(r.doc_id, 4) and r.grown in (r.shard, 4) and r.grown == brute.shard(r.doc_id, 5)
    for s in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id if r.doc_id is not None else -1) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    assert sharding.assign_shards(empty).count() == 0
    assert sharding.with_slots(sharding.assign_shards(empty), "shard", ["doc_id"]).count() == 0


def test_weights_move_few_records(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    both = sharding.assign_shards(sharding.assign_shards(ids, weights=[1, 1, 2]), weights=[1, 1, 4], column="later").collect()
    share = Counter(r.shard for r in both)
    assert abs(share[2] / 4000 - 0.5) < 0.03 and all(r.later in (r.shard, 2) for r in both)


def test_shard_query_columns(spark):
    from palisade.llm.queries import op2_shard

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_shard(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)


def test_line_dedup_of_many_rows_without_id(spark):
    """A third of the rows are one document: their lines go where an id holds them, each row keeps its own list."""
    rows = [(None if i % 3 == 0 else i, f"the line that every document holds\nown line number {i}\nshared by {i % 7} of them") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert brute.rows(line_dedup.dedup_lines(df)) == Counter(brute.line_dedup(rows))
    stored, row = line_dedup.numbered(df, "rows")
    assert max(len(r["keys"]) for r in line_dedup.lost_keys(stored, row).collect()) <= 2


def test_line_dedup(odd, odd_rows, empty):
    got = brute.rows(line_dedup.dedup_lines(odd))
    assert got == Counter(brute.line_dedup([r[:2] for r in odd_rows]))
    assert got[(2, 2, 1, "own text with other words in it")] == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_crowded_filters_only_add_suspects(odd, odd_rows):
    got = brute.rows(line_dedup.dedup_lines(odd, bits=64))
    assert got == Counter(brute.line_dedup([r[:2] for r in odd_rows]))


def test_crowded_filters_report_every_repeat():
    hashes = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 20_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(part), pa.array([False] * len(part))], ["hash", "again"])
               for _ in range(2) for part in np.split(hashes, 20)]
    found = [h for b in line_dedup._suspects(1 << 16)(iter(batches)) for h in b.column("hash").to_pylist()]
    assert set(found) == set(hashes.tolist())


def test_filters_know_what_they_saw():
    import numpy as np

    bloom, seen = line_dedup.Bloom(1 << 16), np.arange(1000, dtype=np.int64) * 7919
    bloom.add(seen)
    assert bloom.holds(seen).all() and bloom.holds(seen + 1).mean() < 0.05


def test_license_places(odd, odd_rows, empty):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                  for r in licenses.scan_licenses(odd).collect())
    want = Counter()
    for r in odd_rows:
        n, starts, labels = brute.base_places(r[1])
        want[r[0], n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels)] += 1
    assert got == want
    assert licenses.scan_licenses(empty).count() == 0


def test_license_notice_with_words_put_in_and_left_out(spark):
    text = ("Redistribution and use in source and binary forms, with or without any modification, are permitted provided "
            "the following conditions are met. MIT License, mit-license; MITlicense")
    df = spark.createDataFrame([(1, text), (2, "with or without the following, are met")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "bsd,mit" and got[1].n_base == 2 and got[1].score == 1.0
    assert got[2].labels == "" and 0 < got[2].score < 0.5


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (2, "other short"),
         (None, "één Été"), (4, None), (5, ""), (6, "the word of the word of the word of the word"), (7, "short ITEM")]


def test_contamination(spark, odd, odd_rows, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = odd.unionByName(spark.createDataFrame(
        [(20, "zero One, two three four five six seven eight nine ten eleven twelve short item", "en", "a", 1),
         (21, "two three four five six seven eight nine ten", "en", "a", 1)], odd.schema))
    rows = [(r.doc_id, r.text) for r in more.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)
                  for r in decontaminate.contamination(more, items).collect())
    want = Counter()
    for doc, text in rows:
        n, hit, found = brute.contamination(text, ITEMS)
        want[doc, n, hit, ",".join(found), hit > 0] += 1
    assert got == want
    assert decontaminate.contamination(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(odd, none).collect()} == {0}
    clash = more.withColumns({c: F.lit(1) for c in ("row", "hit_doc_id", "words", "position")})
    kept = decontaminate.without_contaminated(clash, items)
    assert kept.columns == clash.columns
    hit_ids = {w[0] for w in want if w[2]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in hit_ids)


def test_clean_rows_stay_beside_contaminated_rows_of_their_id(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(None, "zero one two three"), (None, "clean"), (7, "One, two, three"), (7, "also clean"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.without_contaminated(docs, items).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, "clean"), (7, "also clean"), (8, None)])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha b c d beta e f g h i j k alpha x beta"), (2, "alpha " + "z " * 9 + "beta")],
                                 "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([("alpha",), ("beta",)], "term string"))
    found = decontaminate.proximity_matches(
        index, spark.createDataFrame([(9, ["alpha", "beta"])], "query_id long, terms array<string>"), slop=5)
    got = {(r.doc_id, r.position) for r in found.join(index.lengths(), "row").collect()}
    assert got in ({(1, 0), (1, 12)}, {(1, 4), (1, 14)})
