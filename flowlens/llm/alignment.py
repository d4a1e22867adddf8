"""Cross-tokenizer alignment: which byte-level BPE tokens (A) share bytes with which SentencePiece tokens (B), in each document and over all.

Documents go through Arrow in blocks of some megabytes of text: ids are flattened lists with parent indices, byte ends are
segmented cumulative sums of token lengths, an Acero hash join on (document, end) finds where both tokenizers end a token, and the groups
between such ends are joined A to B. ``Table.group_by`` counts each block's documents by id pair, and Spark adds the blocks up. A
block keeps its documents' pairs as numbers into its own table of pairs, so that corpus-wide counts come back to it as one row for
each of its distinct pairs, however often they occur in it.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import dropped, ranges, text_buffer, texts_of, written
from flowlens.llm.pieces import MARKER, fields

#: bytes of text in a block, but for longer documents
BLOCK_BYTES = 3_000_000
#: segments, and bytes of them, whose ids a worker remembers
REMEMBERED, REMEMBERED_BYTES = 500_000, 32_000_000
#: groups of more links are joined by distinct ids, and so many links are expanded at a time
WIDE, LINKS = 64, 2_000_000
SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>, pairs array<long>, docs array<long>"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_table(entries: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(entries, pa.binary()), np.array([len(e) for e in entries], np.int64)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the ids of segments seen before.

    A segment is a run of blanks with what follows up to the next space; the pretokenizer of A and a B without pieces across
    words give a text the ids of its segments, one after the other. For other tokenizers texts are one segment.
    """

    def __init__(self, a_file: str, b_file: str) -> None:
        # Spark has a worker for each core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        letters = byte_of_letter()
        spelled = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.n_a, self.n_b = spelled[-1][1] + 1, self.b.get_piece_size()
        entries = [b""] * self.n_a
        for token, i in spelled:
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_bytes = byte_table(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = byte_table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)])
        n = max(self.n_a, self.n_b)
        self.n, self.said = n, pa.array([sep + str(i) for sep in ("", ",", ";", "|") for i in range(n)], pa.string())
        self.by_segment = self.splits_a() and self.splits_b(pieces)
        self.forget()

    def splits_a(self) -> bool:
        made = json.loads(self.a.to_str())
        before = made["pre_tokenizer"] or {}
        return made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def splits_b(self, pieces: list[str]) -> bool:
        """No piece goes on past a marker after another character, and the normaliser does nothing but mark spaces."""
        rules = next((dict(fields(v)) for k, v in fields(self.b.serialized_model_proto()) if k == 3), {})
        return not rules.get(2) and bool(rules.get(3, 1)) and not rules.get(4, 1) and bool(rules.get(5, 1)) and not any(MARKER in p.lstrip(MARKER) for p in pieces)

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.flat, self.sizes = (array("i"), array("i")), (array("i"), array("i"))

    def numbers(self, segments: list[bytes]) -> np.ndarray:
        """The place of each segment among those remembered; new ones are encoded."""
        if len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.forget()
        get = self.known.get
        out = np.fromiter(map(get, segments, repeat(-1)), np.int64, len(segments))
        new = np.flatnonzero(out < 0)
        out[new] = np.arange(len(self.known), len(self.known) + len(new))
        fresh = [segments[i] for i in new.tolist()]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for side, (ids, sizes) in enumerate((self.encoded_a(part), self.encoded_b(part))):
                self.flat[side].extend(ids)
                self.sizes[side].extend(sizes)
        self.known.update(zip(fresh, out[new].tolist(), strict=True))
        self.size += sum(map(len, fresh))
        return out

    def encoded_b(self, segments: list[bytes]) -> tuple[Iterator[int], Iterator[int]]:
        rows = self.b.encode([s[1:].decode() for s in segments], num_threads=1)
        return chain.from_iterable(rows), map(len, rows)

    def encoded_a(self, segments: list[bytes]) -> tuple[Iterator[int], Iterator[int]]:
        """Segments that end so that no token goes on into the next go to the tokenizer as one text, which is much faster than one by one."""
        joined = b"".join(segments)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        cuts = np.zeros(len(joined) + 1, bool)
        if self.by_segment:
            cuts[segment_starts(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))] = True
        # the last one has nothing after it, but may be followed once others are left out
        whole = [s for s, sure in zip(segments, cuts[ends].tolist(), strict=True) if sure]
        ids: list[int] = self.a.encode_batch_fast([b"".join(whole).decode()], add_special_tokens=False)[0].ids if whole else []
        token_ends, whole_ends = np.cumsum(self.a_bytes[1][ids]), np.cumsum(list(map(len, whole)))
        at = np.searchsorted(token_ends, whole_ends)
        if whole and (at[-1] >= len(ids) or (token_ends[at] != whole_ends).any()):
            raise ValueError("tokens of A go on past the end of a segment")
        counts = iter(np.diff(at, prepend=-1).tolist())
        alone = iter([e.ids for e in self.a.encode_batch_fast([s.decode() for s, sure in zip(segments, cuts[ends].tolist(), strict=True) if not sure], add_special_tokens=False)])
        rows, begin = [], 0
        for sure in cuts[ends].tolist():
            if sure:
                rows.append(ids[begin : begin + (n := next(counts))])
                begin += n
            else:
                rows.append(next(alone))
        return chain.from_iterable(rows), map(len, rows)

    def lists(self, numbers: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """The ids of each numbered segment in A and in B."""
        out = []
        for flat, sizes in zip(self.flat, self.sizes, strict=True):
            ends = np.r_[0, np.cumsum(np.array(sizes, np.int32))].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.int32))).take(pa.array(numbers)))
        return tuple(out)


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text, and at a space after a byte that surely ends no white space of any kind.

    A text's last space begins none: alone it would be an empty text to B, which marks no space then.
    """
    two, three = np.zeros_like(data), np.zeros_like(data)
    two[2:], three[3:] = data[:-2], data[:-3]
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    # white space beyond ASCII is U+0085, U+00A0, U+1680, U+2000 to U+205F in part, and U+3000
    wide = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    begins = (data == 32) & (((before > 32) & (before < 127)) | ((before >= 128) & ~wide))
    some = offsets[:-1] < offsets[1:]
    begins[offsets[1:][some] - 1] = False
    begins[offsets[:-1][some]] = True
    return np.flatnonzero(begins)


def flattened(lists: pa.ListArray, doc_of: np.ndarray, n_docs: int, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document of each, tokens of each document, byte end of each within its document)."""
    ids = pc.list_flatten(lists)
    doc = doc_of[pc.list_parent_indices(lists).to_numpy()]
    many = np.bincount(doc, minlength=n_docs)
    sums = pc.cumulative_sum(pa.array(sizes).take(ids)).to_numpy()
    begins = np.r_[0, sums][np.cumsum(many) - many]
    return ids, doc, many, sums - begins[doc]


def differing(table: pa.Array, ids: pa.Array, doc: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a document's tokens, joined, are other bytes than its text."""
    n = len(offsets) - 1
    length = np.zeros(n, np.int64)
    np.maximum.at(length, doc, ends)
    wrong = length != np.diff(offsets)
    joined, _ = text_buffer(table.take(ids))
    if not wrong.any():
        at = np.flatnonzero(joined != data)
        wrong[np.searchsorted(offsets, at, "right") - 1] = True
        return wrong
    first = np.cumsum(length) - length
    same = np.flatnonzero(~wrong)
    unlike = joined[ranges(first[same], length[same])] != data[ranges(offsets[same], length[same])]
    wrong[np.repeat(same, length[same])[unlike]] = True
    return wrong


def counted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of weights of each."""
    out = pa.table({"key": key, "weight": weight}).group_by("key", use_threads=False).aggregate([("weight", "sum")])
    return out["key"].to_numpy(), out["weight_sum"].to_numpy()


def in_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.r_[first, len(key)])


def linked(a_group: np.ndarray, a: np.ndarray, b_group: np.ndarray, b: np.ndarray, doc_of_group: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """((document * n_a + a) * n_b + b, links of it), distinct and in order.

    The links of most groups are few and expanded. Those of wide ones come from a join of distinct ids with their numbers, in steps of bounded size.
    """
    groups = len(doc_of_group)
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    wide = in_a * in_b > WIDE
    plain = ~wide[a_group]
    left, of = a[plain], a_group[plain]
    many = in_b[of]
    right = b[ranges((np.cumsum(in_b) - in_b)[of], many)]
    keys, weights = in_runs(np.repeat((doc_of_group[of] * n_a + left) * n_b, many) + right)
    if not wide.any():
        return keys, weights
    keys, weights = [keys], [weights]
    one = lambda x: np.ones(len(x), np.int64)
    left, right = ~plain, wide[b_group]
    a_key, a_times = counted(a_group[left] * n_a + a[left], one(a[left]))
    b_key, b_times = counted(b_group[right] * n_b + b[right], one(b[right]))
    order = a_key.argsort()
    a_key, a_times = a_key[order], a_times[order]
    left = pa.table({"group": a_key // n_a, "a": a_key % n_a, "a_times": a_times})
    right = pa.table({"group": b_key // n_b, "b": b_key % n_b, "b_times": b_times})
    grown = np.cumsum(np.bincount(b_key // n_b, minlength=groups)[a_key // n_a])
    cuts = np.unique(np.r_[0, np.searchsorted(grown, np.arange(LINKS, grown[-1], LINKS)), len(a_key)])
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        part = left.slice(x, y - x)
        near = right if len(cuts) == 2 else right.filter(pc.is_in(right["group"], pc.unique(part["group"])))
        links = part.join(near, "group", join_type="inner", use_threads=False)
        group, ia, ib, ta, tb = (links[c].to_numpy() for c in ("group", "a", "b", "a_times", "b_times"))
        key, weight = counted((doc_of_group[group] * n_a + ia) * n_b + ib, ta * tb)
        keys.append(key)
        weights.append(weight)
    key, weight = counted(np.concatenate(keys), np.concatenate(weights))
    order = key.argsort()
    return key[order], weight[order]


def group_digests(said: pa.Array, n: int, sides: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], doc_of_group: np.ndarray, n_docs: int) -> list[str]:
    """The SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``: A's ids of a group, then B's."""
    (a_group, a), (b_group, b) = sides
    groups = len(doc_of_group)
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    new = lambda g: np.r_[True, g[1:] != g[:-1]]
    later = np.r_[False, doc_of_group[1:] == doc_of_group[:-1]]
    a_sep = np.where(new(a_group), 2 * later[a_group], 1)
    b_sep = np.where(new(b_group), 3, 1)
    text = np.empty(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = a_sep * n + a
    text[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = b_sep * n + b
    data, offsets = text_buffer(said.take(pa.array(text)))
    ends = offsets[np.cumsum(np.bincount(doc_of_group, in_a + in_b, n_docs).astype(np.int64))]
    view, begin, out = memoryview(data), 0, []
    for end in ends.tolist():
        out.append(hashlib.sha256(view[begin:end]).hexdigest() if end > begin else "")
        begin = end
    return out


def aligned_block(t: Tokenizers, number: int, doc_ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one with the block's pairs and in how many of its documents each is linked."""
    n = len(texts)
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
    data, offsets = text_buffer(spaced)
    zero = np.zeros(n, np.int64)
    found = {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero}
    digests, empty = [""] * n, np.zeros(0, np.int64)
    key, weight, per_doc = empty, empty, zero
    if len(data):
        starts = segment_starts(data, offsets) if t.by_segment else offsets[:-1][offsets[:-1] < offsets[1:]]
        ends = np.r_[starts, len(data)].astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        numbers = t.numbers(segments.dictionary.to_pylist())[segments.indices.to_numpy()]
        doc_of = np.searchsorted(offsets, starts, "right") - 1
        (a, a_doc, n_a, a_end), (b, b_doc, n_b, b_end) = (flattened(x, doc_of, n, sizes) for x, (_, sizes) in zip(t.lists(numbers), (t.a_bytes, t.b_bytes), strict=True))
        wrong = differing(t.a_bytes[0], a, a_doc, a_end, data, offsets) | differing(t.b_bytes[0], b, b_doc, b_end, data, offsets)
        a, b = a.to_numpy().astype(np.int64), b.to_numpy().astype(np.int64)
        if wrong.any():
            stay_a, stay_b = ~wrong[a_doc], ~wrong[b_doc]
            a, a_doc, a_end, b, b_doc, b_end = a[stay_a], a_doc[stay_a], a_end[stay_a], b[stay_b], b_doc[stay_b], b_end[stay_b]
            n_a, n_b = np.where(wrong, 0, n_a), np.where(wrong, 0, n_b)
        if len(a):
            # the key of an end of a document's token is its place among the block's bytes
            a_key, b_key = (offsets[doc] + end for doc, end in ((a_doc, a_end), (b_doc, b_end)))
            kind = np.int32 if len(data) < 2**31 else np.int64
            both = pa.table({"key": a_key.astype(kind)}).join(pa.table({"key": b_key.astype(kind)}), "key", join_type="inner", use_threads=False)
            cut = np.zeros(len(data) + 1, bool)
            cut[both["key"].to_numpy()] = True
            a_cut, b_cut = cut[a_key].astype(np.int64), cut[b_key].astype(np.int64)
            a_group, b_group = (pc.cumulative_sum(pa.array(c)).to_numpy() - c for c in (a_cut, b_cut))
            doc_of_group = a_doc[a_cut == 1]
            key, weight = linked(a_group, a, b_group, b, doc_of_group, t.n_a, t.n_b)
            per_doc = np.bincount(key // (t.n_a * t.n_b), minlength=n)
            sums = np.r_[0, np.cumsum(weight)][np.r_[0, np.cumsum(per_doc)]]
            found = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of_group, minlength=n), "n_links": np.diff(sums)}
            digests = group_digests(t.said, t.n, ((a_group, a), (b_group, b)), doc_of_group, n)
    coded = pa.array(key % (t.n_a * t.n_b)).dictionary_encode()
    pairs, codes = coded.dictionary, coded.indices
    partial = pa.table({"code": codes}).group_by("code", use_threads=False).aggregate([([], "count_all")])
    docs = np.zeros(len(pairs), np.int64)
    docs[partial["code"].to_numpy()] = partial["count_all"].to_numpy()
    bounds = pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32))
    some = lambda values: pa.ListArray.from_arrays(bounds, values)
    none = lambda size, kind: pa.nulls(size, pa.list_(kind))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    block = pa.array(np.full(n, number), pa.int64())
    columns = [block, doc_ids, *[pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string())]
    yield pa.RecordBatch.from_arrays([*columns, some(codes), some(pa.array(weight)), none(n, pa.int64()), none(n, pa.int64())], names)
    ends = pa.array(np.array([0, len(pairs)], np.int32))
    columns = [block[:1], *[pa.nulls(1, k) for k in [pa.int64()] * 5 + [pa.string()]], none(1, pa.int32()), none(1, pa.int64())]
    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pairs), pa.ListArray.from_arrays(ends, pa.array(docs))], names)


def blocks(documents: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each block's documents, and its table of pairs (in a row without doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = Tokenizers(a_file, b_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sums = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64) + 1)
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + block_bytes, "right")))
                yield from aligned_block(t, number, ids[at:end], texts[at:end])
                at, number = end, number + 1
                pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, SCHEMA)


def aligned(documents: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of tokenizer a_file (A, on a space and the text) with SentencePiece model b_file (B, which adds the space).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Groups are cut where tokens of both end at one byte;
    links are all pairs of an A and a B token of a group. Pairs: a, b, docs (how many documents hold the pair linked) and best
    (no other pair of a is in more documents). n_best counts a document's links of such pairs, count_sum adds docs over its links.

    Strings of special tokens within a text are text. Null and empty texts, and those whose tokens of A or of B
    are, joined, not the bytes of a space and the text (a literal U+2581 is one such case), have no tokens: zeros and an empty string. Rows without an
    id are left out, rows that repeat one are documents of their own, an empty table gives no rows, other columns are ignored.
    """
    texts = texts_of(documents, id_col, text_col)
    made = written(blocks(texts, a_file, b_file, block_bytes), "aligned")
    n_b = pieces_of(b_file)
    a, b = F.expr(f"cast(pair div {n_b} as int)"), (F.col("pair") % n_b).cast("int")
    own = made.where("doc_id is null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("code", "x")).select("block", "code", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = own.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", a)
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = written(counts.join(most, "a").select("pair", "a", b.alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")
    known = own.drop("docs").join(pairs.select("pair", "docs", "best"), "pair").select(F.col("block").alias("of"), "code", "docs", "best")

    def scored(docs: pa.Table, table: pa.Table) -> pa.Table:
        at = table["code"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = table["docs"].to_numpy(), table["best"].to_numpy().astype(np.int64)
        docs = docs.combine_chunks()
        many = np.asarray(pc.list_value_length(docs["codes"])).astype(np.int64)
        codes, times = (pc.list_flatten(docs[c]).to_numpy().astype(np.int64) for c in ("codes", "times"))
        ends = np.r_[0, np.cumsum(many)]
        total = lambda x: np.diff(np.r_[0, np.cumsum(times * x[codes])][ends])
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return out.append_column("n_best", pa.array(total(best), pa.int64())).append_column("count_sum", pa.array(total(count), pa.int64())).append_column("groups_sha256", docs["groups_sha256"])

    rows = made.where("doc_id is not null").drop("pairs", "docs")
    out = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    out = written(out, "alignments")
    dropped(made)
    return out, pairs.select("a", "b", "docs", "best")


def pieces_of(b_file: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_file).get_piece_size()
