"""Appending from peaks gives the chain of the whole run; verification goes on from peaks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import accumulator, ledger

SCHEMA = "run_id string, seq long, kind string, result map<string,double>"


def batch(spark, lengths, start=0):
    rows = [(run, i + 1, "sql", {"v": float(start + i)}) for run, n in lengths.items() for i in range(n)]
    random.Random(start).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def key(rows):
    return sorted((r.run_id, r.seq, r.id, r.prev_hash, r.hash, r.content_hash) for r in rows.collect())


@pytest.mark.parametrize("block", [2, 4, 256])
def test_batches_from_peaks_are_the_chain_of_the_whole(spark, block):
    parts = [{"a": 1, "b": 9}, {"a": 3, "c": 17}, {"b": 1, "a": 16, "c": 47}, {"a": 5}]
    peaks, kept, total = accumulator.no_peaks(spark), [], {}
    for k, lengths in enumerate(parts):
        rows, peaks = accumulator.extend(batch(spark, lengths, 100 * k), peaks, block)
        kept.append(rows.select("run_id", "seq", "id", "kind", "result", "content_hash", "prev_hash", "hash"))
        for run, n in lengths.items():
            total[run] = total.get(run, 0) + n
    whole = kept[0]
    for rows in kept[1:]:
        whole = whole.unionByName(rows)
    content = whole.select("run_id", "seq", "kind", "result")
    assert key(whole) == key(ledger.ledger_append(content, block=block))
    assert {r.run_id: r.n for r in accumulator.run_lengths(peaks).collect()} == total
    assert peaks.groupBy("run_id", "level").count().agg(F.max("count")).first()[0] < block
    assert all(r.chain_valid for r in ledger.ledger_verify(whole, block=block).collect())
    report, again = accumulator.resume(whole, accumulator.no_peaks(spark), block)
    assert all(r.chain_valid and r.checked_rows == total[r.run_id] for r in report.collect())
    assert sorted(again.collect()) == sorted(peaks.collect())


def test_a_long_run_keeps_its_own_blocks(spark):
    first, peaks = accumulator.extend(batch(spark, {"long": 1_000}), accumulator.no_peaks(spark), 8)
    second, grown = accumulator.extend(batch(spark, {"long": 300, "new": 10}, 5_000), peaks, 256)
    assert {(r.run_id, r.block, r.n) for r in accumulator.run_lengths(grown).collect()} == {("long", 8, 1_300), ("new", 256, 10)}
    whole = first.unionByName(second).where("run_id = 'long'")
    assert ledger.ledger_verify(whole, block=8).first().chain_valid
    # no older row is needed to check the new ones
    report = {r.run_id: r for r in accumulator.resume(second, peaks)[0].collect()}
    assert (report["long"].checked_rows, report["long"].chain_valid) == (300, True)


def test_faults_after_the_peaks_are_found(spark):
    first, peaks = accumulator.extend(batch(spark, {"a": 40, "b": 40, "c": 40, "d": 40}), accumulator.no_peaks(spark), 8)
    second, _ = accumulator.extend(batch(spark, {"a": 30, "b": 30, "c": 30, "d": 30}, 900), peaks, 8)
    edited = second.withColumn("result", F.when(F.expr("run_id = 'a' and seq = 55"), F.create_map(F.lit("v"), F.lit(0.5))).otherwise(F.col("result")))
    lost = edited.where("not (run_id = 'b' and seq = 60)")
    doubled = lost.unionByName(lost.where("run_id = 'c' and seq = 50"))
    report = {r.run_id: r for r in accumulator.resume(doubled, peaks)[0].collect()}
    assert (report["a"].chain_valid, report["a"].first_bad_seq) == (False, 55)
    assert not report["b"].chain_valid and not report["c"].chain_valid and report["d"].chain_valid
    moved = second.withColumn("seq", F.when(F.expr("run_id = 'd' and seq in (45, 46)"), 91 - F.col("seq")).otherwise(F.col("seq")))
    assert not {r.run_id: r for r in accumulator.resume(moved, peaks)[0].collect()}["d"].chain_valid


def test_nothing_to_append(spark):
    _, peaks = accumulator.extend(batch(spark, {"a": 5}), accumulator.no_peaks(spark), 4)
    rows, same = accumulator.extend(batch(spark, {}), peaks)
    assert rows.count() == 0 and sorted(same.collect()) == sorted(peaks.collect())
    assert accumulator.resume(rows, peaks)[0].count() == 0


def flat_chain(hashes, block):
    """Links by hand: blocks start from one chain over the digests of all earlier blocks."""
    links, anchor = [], ledger.GENESIS
    for b in range(0, len(hashes), block):
        state, digest = anchor, ledger.GENESIS
        for h in hashes[b : b + block]:
            links.append((state, sha(state + h)))
            state, digest = links[-1][1], sha(digest + h)
        anchor = sha(anchor + digest)
    return links


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_flat_batches_chain_all_digests_in_one_row(spark):
    peaks, kept = accumulator.no_peaks(spark), []
    for k, lengths in enumerate([{"a": 1, "b": 9}, {"a": 2, "c": 24}, {"b": 20, "a": 6}]):
        rows, peaks = accumulator.extend(batch(spark, lengths, 100 * k), peaks, 3, flat=True)
        kept.append(rows)
    whole = kept[0].unionByName(kept[1]).unionByName(kept[2])
    rows = whole.orderBy("seq").collect()
    for run, n in {"a": 9, "b": 29, "c": 24}.items():
        own = [r for r in rows if r.run_id == run]
        assert [r.seq for r in own] == list(range(1, n + 1))
        assert [(r.prev_hash, r.hash) for r in own] == flat_chain([r.content_hash for r in own], 3)
    assert {r.run_id: r.n for r in accumulator.run_lengths(peaks).collect()} == {"a": 9, "b": 29, "c": 24}
    report, again = accumulator.resume(whole, accumulator.no_peaks(spark), 3, flat=True)
    assert all(r.chain_valid for r in report.collect()) and sorted(again.collect()) == sorted(peaks.collect())
    lost = whole.where("not (run_id = 'c' and seq between 7 and 9)")
    report = {r.run_id: (r.chain_valid, r.first_bad_seq) for r in accumulator.resume(lost, accumulator.no_peaks(spark), 3, flat=True)[0].collect()}
    assert report == {"a": (True, None), "b": (True, None), "c": (False, 10)}
    with pytest.raises(ValueError, match="form"):
        accumulator.extend(batch(spark, {"a": 1}), peaks, 3)


def test_rows_are_written_once_per_batch(spark, monkeypatch):
    written = []
    monkeypatch.setattr(accumulator, "cut_lineage", lambda df: written.append(df.columns) or df)
    accumulator.extend(batch(spark, {"a": 9}), accumulator.no_peaks(spark), 4, flat=True)
    assert written == [["run_id", "block", "b", "items", "full", "d"], ["run_id", "block", "b", "start", "after"], ["run_id", "block", "level", "idx", "h"]]
