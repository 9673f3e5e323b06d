"""Removal of long strings that occur earlier in the corpus, found in suffixes that are sorted bucket by bucket.

Which strings can repeat is found first. The window of LENGTH bytes at a place has one anchor, the least hashed string of
ANCHOR bytes in it, which depends on the window alone; so equal windows have equal anchors, and neighbouring windows often
share one. Windows whose anchor occurs once are done. The others go, anchor by anchor, to tasks that sort their suffixes
(suffix_sort) and keep of each group of equal windows the earliest. Copies of whole texts are found by digest before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import bounded, materialise, mix, plain_text, read_table
from emberline.llm.suffix_sort import TEXT, sorted_buckets

LENGTH, ANCHOR = 100, 32
#: Bytes of text whose anchors are found at one time; longer texts are cut, their windows shared out.
PIECE = 1 << 20
#: Bytes of text whose windows are combined before they are sent.
COMBINED = 8 << 20
#: An anchor that occurs more often is sent window by window, as those of one content then meet, however often they occur.
OFTEN = 2000
#: Such anchors that are broadcast (16 MB); more are joined by a shuffle, whose largest partitions Spark splits.
BROADCAST_ANCHORS = 1_000_000
SHARDS_PER_PARTITION = 8
FOUND = np.dtype([("anchor", "<u8"), ("tag", "<i8"), ("d", "<i8"), ("lo", "<i4"), ("more", "u1"), ("several", "?")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    now, reach = values, 1
    while reach * 2 <= width:
        now, reach = np.minimum(now[:-reach], now[reach:]), reach * 2
    rest = width - reach
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def anchor_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: the anchor's hash, the first window's place, and how many more there are.

    data: several texts one after the other, at starts with sizes bytes; no window crosses texts.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)
    n = len(data) - ANCHOR + 1
    hashed = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, by in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        hashed += words[k : k + n] * np.uint64(by)
    hashed = mix(hashed)
    low = np.uint64((1 << 24) - 1)
    chosen = (_least((hashed & ~low) | np.arange(n, dtype=np.uint64), length - ANCHOR + 1) & low).astype(np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    if not len(places):
        return np.zeros(0, np.uint64), places, places
    chosen = chosen[places]
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
    return hashed[chosen[first]], places[first], np.diff(np.r_[first, len(places)]) - 1


def _pieces(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
    """Texts of batches (d, tag, text) as (d, tag, place, bytes), PIECE bytes at a time, long ones in pieces that share no window."""
    held, size = [], 0
    for batch in bounded(batches, "text"):
        texts = plain_text(batch.column("text"))
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ids, tags = batch.column("d").to_numpy(), batch.column("tag").to_numpy()
        for k in range(len(texts)):
            for at in range(int(offsets[k]), int(offsets[k + 1]) - length + 1, PIECE):
                piece = raw[at : min(int(offsets[k + 1]), at + PIECE + length - 1)]
                if held and size + len(piece) > PIECE + length:
                    yield held
                    held, size = [], 0
                held.append((int(ids[k]), int(tags[k]), at - int(offsets[k]), piece))
                size += len(piece)
        if held:  # views of this batch
            yield held
            held, size = [], 0


def _found(pieces: list[tuple[int, int, int, np.ndarray]], length: int) -> np.ndarray:
    """The runs of some texts; of copies among them only those of the first."""
    owner: dict[int, int] = {}
    for d, tag, *_ in pieces:
        owner[tag] = min(d, owner.get(tag, d))
    pieces = [p for p in pieces if owner[p[1]] == p[0]]
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    anchors, places, more = anchor_runs(np.concatenate([p[3] for p in pieces]), starts, sizes, length)
    out = np.zeros(len(anchors), FOUND)
    which = np.searchsorted(starts, places, side="right") - 1
    ids, tags, at = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
    out["anchor"], out["tag"], out["d"], out["lo"], out["more"] = anchors, tags[which], ids[which], places - starts[which] + at[which], more
    out = out[np.argsort(anchors, kind="stable")]
    twice = out["anchor"][1:] == out["anchor"][:-1]
    out["several"] = np.r_[False, twice] | np.r_[twice, False]
    return out


def _anchors(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, known, runs: packed runs, each anchor's at its shard. An anchor that occurs twice in some texts is known to repeat:

    its runs then go anywhere, and only one of them to the anchor's shard, so that no anchor sends more than one run from there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, length):
            found = _found(pieces, length)
            fresh = np.r_[True, found["anchor"][1:] != found["anchor"][:-1]][: len(found)]
            sent, known = found[fresh], found[found["several"]]
            shard = (sent["anchor"] % np.uint64(shards)).astype(np.int64)
            sent, shard = sent[np.argsort(shard, kind="stable")], np.sort(shard)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
            rows = [(int(shard[a]), False, sent[a:b].tobytes()) for a, b in zip(cuts, np.r_[cuts[1:], len(sent)], strict=True)]
            rows += [(int(known["lo"][0]) % shards, True, known.tobytes())] if len(known) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["shard", "known", "runs"])

    return texts.mapInArrow(run, "shard int, known boolean, runs binary")


def _repeated(runs: np.ndarray) -> np.ndarray:
    """Those runs of a shard whose anchor occurs in two texts, or twice in one; runs known to repeat aren't given again."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs["anchor"], kind="stable")]
    first = np.flatnonzero(np.r_[True, runs["anchor"][1:] != runs["anchor"][:-1]])
    sizes = np.diff(np.r_[first, len(runs)])
    lows, highs = np.minimum.reduceat(runs["tag"], first), np.maximum.reduceat(runs["tag"], first)
    again = (lows != highs) | np.logical_or.reduceat(runs["several"], first)
    return runs[np.repeat(again, sizes) & ~runs["several"]]


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, tag, anchor, lo, more: the runs of windows whose anchor occurs again. texts: d, tag (of its text), text."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS_PER_PARTITION * partitions
    sent = _anchors(texts, length, shards).repartition(partitions, "shard").sortWithinPartitions("shard")
    names = ["d", "tag", "anchor", "lo", "more"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, known, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if known:
                    yield rows(np.frombuffer(runs, FOUND))
                    continue
                if shard != now:
                    yield rows(_repeated(np.concatenate(held or [np.zeros(0, FOUND)])))
                    now, held = shard, []
                held.append(np.frombuffer(runs, FOUND))
        yield rows(_repeated(np.concatenate(held or [np.zeros(0, FOUND)])))

    def rows(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c]).view(np.int64) if c == "anchor" else found[c].astype(np.int64 if c in ("d", "tag") else np.int32)) for c in names], names)

    return sent.mapInArrow(run, "d long, tag long, anchor long, lo int, more int")


def _fragments(texts: DataFrame, length: int) -> DataFrame:
    """bucket, d, tag, lo, more, bytes: the text of runs. Of equal runs in some texts the earliest is sent; the others have no bytes, as all their windows occur earlier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for d, tag, text, runs in zip(*(batch.column(c) for c in ("d", "tag", "text", "runs")), strict=True):
                body = text.as_py().encode()
                held.append((d.as_py(), tag.as_py(), body, runs))
                size += len(body)
                if size >= COMBINED:
                    yield from combined(held)
                    held, size = [], 0
        yield from combined(held)

    def combined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        earliest: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        out: list[list] = [[], [], [], [], [], []]
        for d, tag, body, runs in sorted(held, key=lambda x: x[:2]):
            fields = runs.values.flatten()
            order = np.argsort(fields[1].to_numpy())
            for anchor, lo, more, often in zip(*(f.to_numpy(zero_copy_only=False)[order].tolist() for f in fields), strict=True):
                for at in range(lo, lo + more + 1) if often else (lo,):
                    rest = 0 if often else more
                    part = body[at : at + rest + length]
                    bucket = hash_bytes(part) if often else anchor
                    here = (d, at, tag)
                    there = earliest.setdefault((anchor, part), here)
                    if there[:2] < here[:2]:
                        if out[0] and out[5][-1] is None and (out[1][-1], out[2][-1]) == (d, tag) and out[3][-1] + out[4][-1] + 1 == at:
                            out[4][-1] += rest + 1
                        else:
                            for column, value in zip(out, (d, d, tag, at, rest, None), strict=True):
                                column.append(value)
                    elif there is here or there[2] != tag:
                        for column, value in zip(out, (bucket, d, tag, at, rest, part), strict=True):
                            column.append(value)
                if len(out[0]) >= 20_000:
                    last = out[5][-1] is None
                    yield batch_of([c[:-1] if last else c for c in out])
                    out = [c[-1:] if last else [] for c in out]
        yield batch_of(out)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["bucket", "d", "tag", "lo", "more", "bytes"])

    return texts.mapInArrow(run, "bucket long, d long, tag long, lo int, more int, bytes binary")


def hash_bytes(part: bytes) -> int:
    """The same number in every process."""
    return int(mix(np.frombuffer(part + b"\0" * (-len(part) % 8), "<u8") * np.arange(1, -(-len(part) // 8) * 2, 2, dtype=np.uint64)).sum().view(np.int64))


def later_windows(parts: list[bytes], d: np.ndarray, lo: np.ndarray, more: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some runs the windows that occur earlier among them: each maximal stretch's run, first and last place."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    size = int(sizes.sum())
    text = np.frombuffer(b"".join([*parts, b"\0" * (length + 32)]), np.uint8)
    counts = more + 1
    run = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = begins[run] + inside
    order_of = (np.unique(d, return_inverse=True)[1][run] << 32) | (lo[run] + inside)
    row = np.empty(size, np.int64)
    row[places] = np.arange(len(places))
    later = np.zeros(len(places), bool)
    for order, same in sorted_buckets(text, size, places, length):
        rows = row[order]
        first = np.flatnonzero(~same)
        keys = order_of[rows]
        later[rows] = keys > np.repeat(np.minimum.reduceat(keys, first), np.diff(np.r_[first, len(keys)]))
    edge = np.r_[True, run[1:] != run[:-1]]
    opens = np.flatnonzero(later & (edge | ~np.r_[False, later[:-1]]))
    closes = np.flatnonzero(later & (np.r_[edge[1:], True] | ~np.r_[later[1:], False]))
    at = lo[run] + inside
    return run[opens], at[opens], at[closes]


def _spans(fragments: DataFrame, length: int) -> DataFrame:
    """d, tag, start, stop of bytes that a window covers which occurs earlier; whole buckets are sorted, TEXT bytes at most at a time.

    Equal runs of a bucket are one text: it has the runs of one anchor, OFTEN at most, or those of one content.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, alike, done = [], 0, None, {}, []
        for batch in batches:
            ended = batch.filter(batch.column("bytes").is_null())
            yield spans(*(ended.column(c).to_numpy().astype(np.int64) for c in ("d", "tag", "lo", "more")))
            batch = batch.filter(batch.column("bytes").is_valid())
            for bucket, d, tag, lo, more, part in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if bucket != now:
                    if size > TEXT // 4:
                        yield sorted_(held)
                        held, size = [], 0
                    now, alike = bucket, {}
                at = alike.get(part)
                if at is None or held[at][0] == d and held[at][2] == lo:
                    alike[part] = len(held)
                    held.append((d, tag, lo, more, part))
                    size += len(part)
                    continue
                if (d, lo) < (held[at][0], held[at][2]):
                    held[at], (d, tag, lo) = (d, tag, lo, more, part), held[at][:3]
                done.append((d, tag, lo, more))
            if done:
                yield spans(*np.array(done, np.int64).T)
                done = []
        if held:
            yield sorted_(held)

    def sorted_(held: list[tuple]) -> pa.RecordBatch:
        d, tag, lo, more = (np.array([h[k] for h in held], np.int64) for k in range(4))
        which, first, last = later_windows([h[4] for h in held], d, lo, more, length)
        return spans(d[which], tag[which], first, last - first)

    def spans(d: np.ndarray, tag: np.ndarray, lo: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(tag), pa.array(lo.astype(np.int32)), pa.array((lo + more + length).astype(np.int32))], ["d", "tag", "start", "stop"])

    return fragments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "d long, tag long, start int, stop int")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Spans (d, tag, start, stop) of texts (d, tag, sha, text) that occur earlier, and copies (d, tag) that do as a whole."""
    alike = texts.groupBy("sha").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = materialise(texts.select("d", "tag", "sha").join(alike, "sha").where("d > first").select("d", "tag").distinct(), "copies")
    long = texts.where(F.octet_length("text") >= length).select("d", "tag", "text")
    runs = materialise(repeated_runs(long, length), "runs")
    often = materialise(runs.groupBy("anchor").count().where(F.col("count") > OFTEN).select("anchor", F.lit(True).alias("often")), "often")
    # Shuffled by anchor, those that occur often would meet in a task; their number is known here.
    runs = runs.join(F.broadcast(often) if often.count() <= BROADCAST_ANCHORS else often, "anchor", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    by_text = runs.groupBy("d", "tag").agg(F.collect_list(F.struct("anchor", "lo", "more", "often")).alias("runs")).join(copies, ["d", "tag"], "left_anti")
    fragments = _fragments(long.join(by_text, ["d", "tag"]), length)
    return materialise(_spans(fragments, length), "spans"), copies


def _cut(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of body, and how many maximal runs go."""
    kept, at, runs, stop = [], 0, 0, -1
    for start, end in sorted(spans):
        if start > stop:
            kept.append(body[at:start])
            runs += 1
        stop = max(stop, end)
        at = stop
    kept.append(body[at:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each row of docs without the bytes that an earlier string of length bytes covers.

    Texts are UTF-8 bytes, null is empty; kept is binary, as a cut may fall inside a character. Earlier is a smaller doc_id
    (null is the smallest), or the same one and an earlier start; so of rows of one doc_id, repeated ones too, none is
    earlier at the same start. Strings are judged on the input. Other columns don't take part. Texts may have any length
    below 2 GB; an empty table gives an empty one. length: 40 to 280, else there is a ValueError.
    """
    if not 40 <= length <= 280:
        raise ValueError("strings of 40 to 280 bytes can be sought")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), body.alias("text"))
    rows = rows.withColumns({"d": F.coalesce("id", F.lit(-(2**63))), "tag": F.xxhash64("text")})
    spans, copies = repeated_spans(rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), length)
    lists = spans.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    judged = rows.join(lists, ["d", "tag"], "left").join(copies.withColumn("copy", F.lit(True)), ["d", "tag"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            out: list[tuple] = []
            for doc, body, spans, copy in zip(*(batch.column(c) for c in ("id", "text", "spans", "copy")), strict=True):
                data = body.as_py().encode()
                pairs = [(0, len(data))] if copy.as_py() and len(data) >= length else [tuple(s.values()) for s in spans.as_py() or []]
                kept, n = _cut(data, pairs)
                out.append((doc.as_py(), len(data), len(data) - len(kept), n, kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return judged.select("id", "text", "spans", "copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the bytes that strings of 100 bytes cover which occur earlier, as a digest."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
