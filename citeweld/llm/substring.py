"""Substring deduplication by seed and extend.

Seeds: the words of a text are cut into 8-grams, and of each 13 successive ones the least hash is an anchor (winnowing),
so every passage of 20 words holds an anchor that depends on those words alone. Anchors are joined on their hash; an
anchor that occurs once ends there. Extension: each recurring anchor is extended both ways to all the 20-word windows
that it leads, and the windows of an anchor's occurrences are compared, first as a whole (their common extension) and
then one by one, so that a repeat reaches as far as the words agree. Overlapping windows join into maximal repeats.

No pairs of occurrences are made: an occurrence is compared with the earliest one by sorting. What recurs within a task
is settled there, so a passage that a third of all texts hold sends a row or two from each task. Texts are shuffled
once, by document; two joins read that one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import batch, ints, lists, runs, tidy, whole_groups
from ._spark import from_key, id_key, read, text_of
from ._words import U, Chunk, chunks, grams, mix, ranges

WINDOW = 20  # words that make a repeat
SEED = 8  # words of an anchor
PART = 63  # windows that the bits of a number stand for
HOLD = 1_000_000  # anchors that a task holds before it settles what recurs among them


def _anchors(c: Chunk, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie within a text, the anchor that leads each, and the hash of every seed-gram."""
    per = np.diff(c.off)
    start = ranges(c.off[:-1], np.maximum(per - window + 1, 0))
    g = grams(c.hash, seed)
    if not len(start):
        return start, start, g
    last = len(g) - 1
    # the least hash wins, of equal ones the rightmost: low bits hold the place, counted from the end
    low = (g & U(0xFFFFFFFFFF000000)) | (U(last & 0xFFFFFF) - (np.arange(len(g), dtype=U) & U(0xFFFFFF)) & U(0xFFFFFF))
    span, have, least = window - seed + 1, 1, low
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    back = (last & 0xFFFFFF) - (least[start] & U(0xFFFFFF)).astype(np.int64) & 0xFFFFFF
    lead = start + ((back - start) & 0xFFFFFF)  # places are known modulo 2**24
    return start, lead, g


def _settle_seeds(keys: list, docs: list, at: list) -> Iterator[pa.RecordBatch]:
    k, d, p = np.concatenate(keys), np.concatenate(docs), np.concatenate(at)
    order = np.argsort(k, kind="stable")
    k, d, p = k[order], d[order], p[order]
    first, n = runs(k)
    often = np.repeat(n > 1, n)
    own = mix(d[often].astype(U) * U(31) + p[often].astype(U)).view(np.int64)  # these need no comparison: any task will do
    marks = first[n > 1]
    yield batch(
        k=np.r_[k[~often].view(np.int64), own, k[marks].view(np.int64)],
        doc=np.r_[d[~often], d[often], d[marks]],
        pos=np.r_[p[~often], p[often], np.full(len(marks), -1)].astype(np.int32),
        known=np.r_[np.zeros((~often).sum(), bool), np.ones(often.sum(), bool), np.zeros(len(marks), bool)],
    )


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, at, held = [], [], [], 0
        for b in batches:
            doc = ints(b["doc"])
            for c in chunks(b["text"]):
                start, lead, g = _anchors(c, window, seed)
                if not len(start):
                    continue
                lead = lead[np.r_[True, lead[1:] != lead[:-1]]]
                text = np.searchsorted(c.off, lead, "right") - 1
                keys.append(g[lead])
                docs.append(doc[c.first + text])
                at.append(lead - c.off[text])
                held += len(lead)
                if held >= HOLD:
                    yield from _settle_seeds(keys, docs, at)
                    keys, docs, at, held = [], [], [], 0
        if held:
            yield from _settle_seeds(keys, docs, at)

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "k"):
        k, pos, known = ints(t["k"]), ints(t["pos"]), t["known"].combine_chunks().to_numpy(zero_copy_only=False)
        first, n = runs(k)
        keep = (np.repeat(n > 1, n) | known) & (pos >= 0)
        yield batch(doc=ints(t["doc"])[keep], pos=pos[keep].astype(np.int32))


def _settle_spans(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    x = {k: np.concatenate([p.pop(k) for p in parts]) for k in list(parts[0])}
    off = np.cumsum(x["n"]) - x["n"]
    order = np.lexsort((x["lo"], x["tie"], x["did"], x["n"], x["print"], x["k"]))
    s = {k: x[k][order] for k in ("k", "print", "n", "did", "tie", "lo")}
    new = np.r_[True, (s["k"][1:] != s["k"][:-1]) | (s["print"][1:] != s["print"][:-1]) | (s["n"][1:] != s["n"][:-1])]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (s["did"] == s["did"][lead]) & (s["tie"] == s["tie"][lead]) & (s["lo"] == s["lo"][lead])
    dup = ~new & ~same  # the same words start earlier in this task
    sent = order[new]
    n = x["n"][sent]
    yield batch(
        k=np.r_[x["k"][sent].view(np.int64), mix(s["did"][dup].astype(U) * U(31) + s["lo"][dup].astype(U)).view(np.int64)],
        did=np.r_[x["did"][sent], s["did"][dup]],
        tie=np.r_[x["tie"][sent], s["tie"][dup]],
        lo=np.r_[x["lo"][sent], s["lo"][dup]].astype(np.int32),
        n=np.r_[n, s["n"][dup]].astype(np.int32),
        windows=lists(x["_w"][ranges(off[sent], n)].view(np.int64), np.r_[n, np.zeros(dup.sum(), np.int64)]),
    )


def _spans(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            did, tie, seeds = ints(b["did"]), ints(b["tie"]), b["seeds"]
            where = seeds.value_lengths().to_numpy(zero_copy_only=False)
            at = ints(seeds.flatten())
            begin = np.cumsum(where) - where
            for c in chunks(b["text"]):
                start, lead, g = _anchors(c, window, seed)
                own = slice(c.first, c.first + c.texts)
                mine = at[ranges(begin[own], where[own])]
                text = np.repeat(np.arange(c.texts), where[own])
                inside = mine < np.diff(c.off)[text]  # places of another document with the same hash may lie outside
                wanted = np.zeros(len(c.hash) + 1, bool)
                wanted[(c.off[text] + mine)[inside]] = True
                pick = wanted[lead]
                start, lead = start[pick], lead[pick]
                if not len(start):
                    continue
                w = grams(c.hash, window)[start]
                text = np.searchsorted(c.off, start, "right") - 1
                new = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])])
                n = np.diff(np.r_[new, len(start)])
                step = np.arange(len(start)) - np.repeat(new, n)
                if len(n) and n.max() > PART:  # what a number cannot hold a bit for goes into a part of its own
                    step %= PART
                    new = np.flatnonzero(step == 0)
                    n = np.diff(np.r_[new, len(start)])
                parts.append({"k": g[lead[new]], "print": np.add.reduceat(mix(w + step.astype(U) * U(0x9E3779B97F4A7C15)), new), "n": n, "did": did[c.first + text[new]], "tie": tie[c.first + text[new]], "lo": start[new] - c.off[text[new]], "_w": w})
                held += len(w)
                if held >= 2 * HOLD:
                    yield from _settle_spans(parts)
                    parts, held = [], 0
        if parts:
            yield from _settle_spans(parts)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows under an anchor, those whose words start earlier too, as bits from lo on."""
    for t in whole_groups(batches, "k"):
        k, did, tie, lo, n = (ints(t[c]) for c in ("k", "did", "tie", "lo", "n"))
        spans = t["windows"].combine_chunks()
        own = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        w = ints(spans.flatten())
        row = np.repeat(np.arange(len(k)), own)
        step = np.arange(len(w)) - np.repeat(np.cumsum(own) - own, own)
        pos = lo[row] + step
        order = np.lexsort((pos, tie[row], did[row], w, k[row]))
        ok, ow, orow, opos = k[row][order], w[order], row[order], pos[order]
        new = np.r_[True, (ok[1:] != ok[:-1]) | (ow[1:] != ow[:-1])] if len(w) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(w) else np.zeros(0, np.int64)
        same = (did[orow] == did[orow[lead]]) & (tie[orow] == tie[orow[lead]]) & (opos == opos[lead])
        bits = np.zeros(len(k), np.int64)
        hit = ~new & ~same
        np.bitwise_or.at(bits, orow[hit], np.int64(1) << step[order][hit])
        bits = np.where(own == 0, (np.int64(1) << n) - 1, bits)
        keep = bits != 0
        yield batch(did=did[keep], tie=tie[keep], lo=lo[keep].astype(np.int32), bits=bits[keep])


def _cut(window: int, names: list[str]):
    from itertools import compress

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tie, found = ints(b["tie"]), b["found"]
            size = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            ftie, flo, fbits = (ints(flat.field(i)) for i in range(3))
            begin = np.cumsum(size) - size
            for c in chunks(b["text"]):
                kept, loose, n_words, n_removed, span_n, spans = [], [], [], [], [], []
                for i in range(c.texts):
                    r = c.first + i
                    a, z = int(c.bounds[i]), int(c.bounds[i + 1])
                    raw = c.data[a:z].tobytes()
                    words = raw.split()
                    gone = np.zeros(len(words), bool)
                    if size[r]:
                        f = slice(begin[r], begin[r] + size[r])
                        mine = ftie[f] == tie[r]
                        edge = np.zeros(len(words) + 1, np.int64)
                        for lo, bits in zip(flo[f][mine].tolist(), fbits[f][mine].tolist(), strict=True):
                            while bits:
                                low = bits & -bits
                                at = lo + low.bit_length() - 1
                                edge[at] += 1
                                edge[at + window] -= 1
                                bits ^= low
                        gone = np.cumsum(edge)[:-1] > 0
                    k = int(gone.sum())
                    kept.append(b" ".join(compress(words, ~gone) if k else words))
                    first, n = runs(gone)
                    first, n = first[gone[first]], n[gone[first]]
                    if k:  # the text as it is laid out, without the repeats
                        s = c.start[c.off[i] : c.off[i + 1]] - a
                        out, at = [], 0
                        for x, m in zip(first.tolist(), n.tolist(), strict=True):
                            out.append(raw[at : s[x]])
                            at = int(s[x + m]) if x + m < len(s) else len(raw)
                        loose.append(b"".join([*out, raw[at:]]))
                    else:
                        loose.append(raw)
                    n_words.append(len(words))
                    n_removed.append(k)
                    span_n.append(len(first))
                    spans.append(np.stack([first, n], 1).reshape(-1))
                flat_spans = np.concatenate(spans) if spans else np.zeros(0, np.int64)
                part = b.slice(c.first, c.texts)
                removed = lists_of_pairs(flat_spans, np.array(span_n))
                yield pa.RecordBatch.from_arrays([*[part[x] for x in names], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(loose, pa.binary()).cast(pa.string()), removed], names=[*names, "n_words", "n_removed", "kept", "kept_layout", "removed"])

    return run


def lists_of_pairs(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    pair = pa.StructArray.from_arrays([pa.array(flat[::2].astype(np.int64)), pa.array(flat[1::2].astype(np.int64))], names=["start", "words"])
    return pa.ListArray.from_arrays(pa.array(offsets), pair)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Each document without the words of passages that start earlier in the corpus too.

    A passage is ``window`` words in a row; it is a repeat where its words also start in a smaller id, or earlier in
    the same document. Returns ``id_col``, the ``carry`` columns, ``n_words``, ``n_removed``, ``kept`` (the words left,
    one space between), ``kept_layout`` (the text with the repeats cut out) and ``removed`` (maximal repeats: first
    word and number of words).

    Null texts have no words; empty texts give an empty ``kept``. A null id counts as the smallest. Rows with one id
    and one text are one document and all get its result; of several texts under an id, that with the smaller
    ``xxhash64`` counts as earlier. Documents are told apart by id and text, so many texts under one id, or under none,
    cost no more than under ids of their own. Other columns of docs are not looked at, whatever their names; an empty
    table gives an empty result. A window shorter than a seed is a ``ValueError``.
    """
    if not 0 < seed <= window:
        raise ValueError(f"a window of {window} words holds no seed of {seed}")
    names = [f"_c{i}" for i in range(len(carry))]
    text = text_of(text_col)
    texts = docs.select(id_key(id_col).alias("did"), F.xxhash64(text).alias("tie"), text.alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    doc = F.xxhash64("did", "tie").alias("doc")  # of equal texts another one for each id
    texts = texts.select("*", doc)
    seeds = texts.select("doc", "text").mapInArrow(tidy(_seeds(window, seed)), "k long, doc long, pos int, known boolean")
    places = seeds.repartition("k").sortWithinPartitions("k").mapInArrow(tidy(_recurring), "doc long, pos int")
    by_doc = places.groupBy("doc").agg(F.collect_set("pos").alias("seeds"))  # rows that repeat a document find the same places
    spans = texts.join(by_doc.hint("shuffle_hash"), "doc").select("did", "tie", "text", "seeds").mapInArrow(tidy(_spans(window, seed)), "k long, did long, tie long, lo int, n int, windows array<long>")
    repeats = spans.repartition("k").sortWithinPartitions("k").mapInArrow(tidy(_repeats), "did long, tie long, lo int, bits long")
    found = repeats.groupBy(doc).agg(F.collect_set(F.struct("tie", "lo", "bits")).alias("found"))
    kinds = "".join(f", {n} {docs.select(f'`{c}`').schema[0].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))
    out = texts.join(found.hint("shuffle_hash"), "doc", "left").mapInArrow(tidy(_cut(window, ["did", *names])), f"did long{kinds}, n_words long, n_removed long, kept string, kept_layout string, removed array<struct<start: long, words: long>>")
    return out.select(from_key("did").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_words", "n_removed", "kept", "kept_layout", "removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeats of 20 words are gone; see ``remove_repeats``."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS s FROM w),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM n),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM g WHERE k > 1),
l AS (SELECT doc_id, list(i) AS r FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(r), 0) AS n_removed, list_filter(list_transform(ws, lambda x, i: CASE WHEN list_contains(coalesce(r, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
