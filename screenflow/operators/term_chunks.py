"""Terms of a large lexicon, met by chunks of texts: what moves grows with the texts, not with their matches.

A text names most of a large lexicon's words, so a row for each match, or for each run
that may be a term, takes many times the room of the texts. Here texts move once, as
lines of words, to the task of their chunk. A chunk asks for each distinct run that passes
a sieve of the lexicon once, however many of its texts have it, and gets its own small part
of the lexicon back. Its texts then meet that part in the memory of one task, exactly, and
a text's matches are summed there: no match is moved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, PLACE, LINE, BUCKET, BODY = "_chunk", "_place", "_line", "_bucket", "_body"
#: Bytes of text in a chunk, which one task holds with what it needs of the lexicon.
CHUNK_BYTES = 8 << 20
#: Entries of the lexicon in a bucket, of which one task holds the whole.
BUCKET_TERMS = 250_000
#: Few texts are still spread over the shuffle partitions, in chunks of as many bytes at least.
LEAST_BYTES = 1 << 20
#: Slots of the sieve for each term, of which there is one bit, and the most slots: a sieve that is too
#: small lets more runs ask, and no fewer.
SLOTS_PER_TERM, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Slots that one task fills.
BLOCK_BITS = 20


@dataclass(frozen=True)
class Words:
    """Lines cut into words: a number for each word, and the line that it stands in."""

    ids: np.ndarray
    line: np.ndarray
    vocabulary: pa.Array

    @classmethod
    def of(cls, lines: pa.ChunkedArray | pa.Array) -> Words:
        lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
        cut = pc.split_pattern(lines.cast(pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        line = np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(cut.offsets.to_numpy()))
        return cls(coded.indices.to_numpy(), line, coded.dictionary)

    def begins(self, n: int, whole: np.ndarray | None = None) -> np.ndarray:
        """Where runs of ``n`` words of one line begin; ``whole`` lines have no runs of several words."""
        last = len(self.ids) - n + 1
        if last <= 0:
            return np.zeros(0, np.int32)
        if n == 1:
            return np.arange(last, dtype=np.int32)
        inside = self.line[:last] == self.line[n - 1 :]
        return np.flatnonzero(inside if whole is None else inside & ~whole[self.line[:last]]).astype(np.int32)


def _sorted_set(x: np.ndarray) -> np.ndarray:
    """As `np.unique`, whose hash table is slow for many values."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[0] - 1) != 0] if len(x) else x


def _firsts(code: np.ndarray) -> np.ndarray:
    """Where each of the small numbers stands first."""
    first = np.full(code.max(initial=-1) + 1, -1)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first[first >= 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))


def run_hashes(words: Words, hashes: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; its high bits are a slot of the sieve, its rest gives a bucket."""
    run = hashes[words.ids[begins]]
    for k in range(1, n):
        run = _mixed(run) + hashes[words.ids[begins + k]]
    return _mixed(run)


def slots_of(run: np.ndarray, bits: int) -> np.ndarray:
    return (run >> np.uint64(64 - bits)).astype(np.int64)


def cut_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about the bytes of a chunk."""
    for batch in batches:
        step = max(1, len(batch) * CHUNK_BYTES // max(batch.nbytes, 1))
        for start in range(0, len(batch), step):
            yield batch.slice(start, step)


def gathered(batches: Iterator[pa.RecordBatch], n_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= n_rows:
            yield pa.concat_batches(some)
            some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def distinct_runs(words: Words, begins: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """A place of each distinct run of ``n`` words among those that begin there, and the runs as texts."""
    code, n_words = words.ids[begins], len(words.vocabulary)
    for k in range(1, n):
        code = np.unique(code.astype(np.int64) * n_words + words.ids[begins + k], return_inverse=True)[1]
    at = begins[_firsts(code)]
    parts = [words.vocabulary.take(pa.array(words.ids[at + k])) for k in range(n)]
    run = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    return at, run.cast(pa.string())


def term_hashes(terms: pa.Array) -> np.ndarray:
    words = Words.of(terms)
    hashes, sizes = word_hashes(words.vocabulary), np.bincount(words.line, minlength=len(terms))
    starts, run = np.cumsum(sizes) - sizes, np.zeros(len(terms), np.uint64)
    for n in np.unique(sizes):
        run[sizes == n] = run_hashes(words, hashes, starts[sizes == n], int(n))
    return run


def sieve_of(terms: DataFrame, n_terms: int) -> tuple[int, bytes]:
    """A bit for each slot of a hash of the terms: a run whose bit is not set is no term."""
    bits = min(max(int(n_terms * SLOTS_PER_TERM).bit_length(), LEAST_BITS), MOST_BITS)
    block_bits = min(BLOCK_BITS, bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BUCKET_TERMS):
            slot = _sorted_set(slots_of(term_hashes(batch["term"]), bits))
            block, place = slot >> block_bits, slot & ((1 << block_bits) - 1)
            yield pa.record_batch({"block": block.astype(np.int32), "place": place.astype(np.int32)})

    def filled(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << block_bits, bool)
        on[table["place"].to_numpy()] = True
        return pa.table({"block": table["block"][:1], "body": pa.array([np.packbits(on, bitorder="little").tobytes()])})

    blocks = terms.select("term").mapInArrow(slots, "block int, place int").groupBy("block").applyInArrow(filled, "block int, body binary")
    found = {r["block"]: bytes(r["body"]) for r in blocks.collect()}
    nothing = bytes((1 << block_bits) >> 3)
    return bits, b"".join(found.get(k, nothing) for k in range(1 << (bits - block_bits)))


def released(step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The step, after which its worker holds no more memory than its result takes."""

    def freed(out: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return out

    # Spark looks at the number of parameters.
    if step.__code__.co_argcount == 1:
        return lambda table: freed(step(table))
    return lambda left, right: freed(step(left, right))


def packed(terms: pa.Array, numbers: Sequence[pa.Array] = ()) -> bytes:
    """Terms, in alphabetical order for their beginnings' sake, and their numbers, which may be null, in little room."""
    order = pc.sort_indices(terms)
    lists = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.take(order))
    parts = [pc.binary_join(lists, "\n")[0].as_buffer().to_pybytes()]
    for column in numbers:
        column = column.take(order)
        parts += [np.packbits(column.is_null().to_numpy(zero_copy_only=False)).tobytes(), column.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes()]
    raw = b"".join(parts)
    return struct.pack("<qqq", len(raw), len(terms), len(parts[0])) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(body: bytes, names: Sequence[str] = ()) -> pa.Table:
    size, n, ends = struct.unpack_from("<qqq", body)
    raw = pa.decompress(memoryview(body)[24:], decompressed_size=size, codec="zstd", asbytes=True)
    out = {"term": pc.split_pattern(pa.array([raw[:ends]], pa.binary()).cast(pa.string()), "\n").flatten()}
    for name in names:
        nulls = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, ends), count=n).astype(bool)
        ends += (n + 7) // 8
        out[name] = pa.array(np.frombuffer(raw, np.float64, n, ends), mask=nulls)
        ends += 8 * n
    return pa.table(out)


def _cells(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The members of each group."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(group)], strict=False):
        yield int(group[order[i]]), order[i:j]


def _spread(starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every member of each of the groups: which of them, and the member's place."""
    n = sizes[groups]
    each = np.repeat(np.arange(len(groups)), n)
    return each, starts[groups][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def term_cells(n_buckets: int, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_bucket, body``: terms with their numbers, packed by the bucket of their hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BUCKET_TERMS):
            bucket = (term_hashes(batch["term"]) % np.uint64(n_buckets)).astype(np.int64)
            found = [(b, packed(batch["term"].take(pa.array(at)), [batch[c].take(pa.array(at)) for c in names])) for b, at in _cells(bucket)]
            yield pa.record_batch({BUCKET: pa.array([b for b, _ in found], pa.int32()), BODY: pa.array([x for _, x in found], pa.binary())})

    return pack


def askers(lengths: Sequence[int], bits: int, sieve: Broadcast, tag_place: int, n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    """``_bucket, _chunk, body``: the distinct runs of a chunk that may be terms, packed by bucket."""

    def ask(table: pa.Table) -> pa.Table:
        words = Words.of(table[LINE])
        whole = table[PLACE].to_numpy() == tag_place
        on = np.frombuffer(sieve.value, np.uint8)
        hashes = word_hashes(words.vocabulary)
        runs, buckets = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for n in lengths:
            at = _firsts(words.ids) if n == 1 else words.begins(n, whole)
            slot = slots_of(run_hashes(words, hashes, at, n), bits)
            at = at[(on[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            at, run = distinct_runs(words, at, n)
            runs.append(run)
            buckets.append((run_hashes(words, hashes, at, n) % np.uint64(n_buckets)).astype(np.int64))
        run, chunk = pa.concat_arrays(runs), table[CHUNK][0].as_py()
        found = [(b, packed(run.take(pa.array(at)))) for b, at in _cells(np.concatenate(buckets))]
        return pa.table({
            BUCKET: pa.array([b for b, _ in found], pa.int32()), CHUNK: pa.array([chunk] * len(found), pa.int32()),
            BODY: pa.array([x for _, x in found], pa.binary()),
        })

    return released(ask)


def answers(names: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``_chunk, body``: of a bucket's terms, with their numbers, those that a chunk asked for."""

    def answer(asked: pa.Table, terms: pa.Table) -> pa.Table:
        chunks, bodies = [], []
        if len(asked) and len(terms):
            own = pa.concat_tables([unpacked(b, names) for b in terms[BODY].to_pylist()]).combine_chunks()
            own = own.take(pc.sort_indices(own["term"])).combine_chunks()
            # Entries of one term are neighbours.
            distinct = own["term"].combine_chunks().dictionary_encode()
            sizes = np.bincount(distinct.indices.to_numpy(), minlength=len(distinct.dictionary))
            starts = np.cumsum(sizes) - sizes
            wanted = [unpacked(b)["term"].combine_chunks() for b in asked[BODY].to_pylist()]
            places = pc.index_in(pa.concat_arrays(wanted), distinct.dictionary).fill_null(-1).to_numpy()
            ends = np.cumsum([len(x) for x in wanted])[:-1]
            for chunk, at in zip(asked[CHUNK].to_pylist(), np.split(places, ends), strict=True):
                at = at[at >= 0]
                if not len(at):
                    continue
                got = own.take(pa.array(_spread(starts, sizes, at)[1])).combine_chunks()
                chunks.append(chunk)
                bodies.append(packed(got["term"].combine_chunks(), [got[c].combine_chunks() for c in names]))
        return pa.table({CHUNK: pa.array(chunks, pa.int32()), BODY: pa.array(bodies, pa.binary())})

    return released(answer)


def met(words: Words, terms: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and term of all runs of words that are terms, by a tree of the terms' words."""
    own = Words.of(terms)
    n_words = len(words.vocabulary)
    known = pc.index_in(own.vocabulary, words.vocabulary).fill_null(n_words).to_numpy().astype(np.int64)
    ids, sizes = known[own.ids], np.bincount(own.line, minlength=len(terms))
    starts = np.cumsum(sizes) - sizes
    lines, found = [], []
    at, node = np.arange(len(words.ids), dtype=np.int32), words.ids
    rest, rest_node = np.arange(len(terms)), ids[starts]
    n_nodes = n_words + 1
    for n in range(1, int(sizes.max(initial=0)) + 1):
        if n > 1:
            longer = sizes[rest] >= n
            rest, rest_node = rest[longer], rest_node[longer]
            begun = np.zeros(n_nodes, bool)
            begun[rest_node] = True
            goes_on = begun[node] & (at + n - 1 < len(words.ids))
            at, node = at[goes_on], node[goes_on]
            inside = (words.line[at] == words.line[at + n - 1]) & ~whole[words.line[at]]
            at, node = at[inside], node[inside]
            follows = np.zeros(n_words + 1, bool)
            follows[ids[starts[rest] + n - 1]] = True
            ok = follows[words.ids[at + n - 1]]
            at, node = at[ok], node[ok]
            nodes, rest_node = np.unique(rest_node * (n_words + 1) + ids[starts[rest] + n - 1], return_inverse=True)
            key = node.astype(np.int64) * (n_words + 1) + words.ids[at + n - 1]
            node = np.searchsorted(nodes, key)
            ok = nodes[np.minimum(node, len(nodes) - 1)] == key
            at, node = at[ok], node[ok]
            n_nodes = len(nodes)
        term_of = np.full(n_nodes, -1, np.int32)
        ends = sizes[rest] == n
        term_of[rest_node[ends]] = rest[ends]
        term = term_of[node]
        hit = term >= 0
        lines.append(words.line[at[hit]])
        found.append(term[hit])
    return np.concatenate([np.zeros(0, np.int32), *lines]), np.concatenate([np.zeros(0, np.int32), *found])


def _joined(row: np.ndarray, term: np.ndarray, terms: pa.Array, n_rows: int) -> pa.Array:
    """The distinct terms of each row, one in a line; null for none. They come by row, then by term."""
    new = (np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0)
    row, term = row[new], term[new]
    ends = np.cumsum(np.bincount(row, minlength=n_rows))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), terms.take(pa.array(term, pa.int64())).cast(pa.string()))
    text = pc.binary_join(lists, "\n")
    return pc.if_else(pa.array(np.diff(ends, prepend=0) > 0), text, pa.scalar(None, pa.string()))


def summed(weights: dict[int, float], tag_place: int, stages: Sequence[str], conditions: str | None, key: str, content: str):
    """Of the lines of a chunk and the entries that it got back: what the stages need to know of each text.

    ``weights`` has the weight of a field by its place, a bit of its own; ``conditions``
    names the column for the terms of the hashtag signal among the tags.
    """
    texts, names = sum(weights), [*(["named"] if conditions else []), "weight", *stages]
    nothing = pa.table({"term": pa.array([], pa.string())} | {c: pa.array([], pa.float64()) for c in names})

    def sum_up(lines: pa.Table, cells: pa.Table) -> pa.Table:
        lines = lines.combine_chunks()
        entries = pa.concat_tables([unpacked(b, names) for b in cells[BODY].to_pylist()] or [nothing]).combine_chunks()
        keys = lines.select([key, content]).append_column("at", pa.array(np.arange(len(lines))))
        rows = keys.group_by([key, content], use_threads=False).aggregate([("at", "list")])
        n_rows = len(rows)
        row_of = np.zeros(len(lines), np.int64)
        members = rows["at_list"].combine_chunks()
        row_of[members.flatten().to_numpy()] = np.repeat(np.arange(n_rows), np.diff(members.offsets.to_numpy()))
        place_of = lines[PLACE].to_numpy()
        coded = entries["term"].combine_chunks().dictionary_encode()
        # Terms in order, so that the sums of a text do not depend on the order in which entries came.
        order = pc.sort_indices(coded.dictionary).to_numpy()
        terms, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        entry_term = rank[coded.indices.to_numpy()]
        line, term = met(Words.of(lines[LINE]), terms, place_of == tag_place)
        # One for each term of a text, with the places that have it.
        n_terms = max(len(terms), 1)
        all_of = _sorted_set(((row_of[line] * n_terms + term) << 6) | np.log2(place_of).astype(np.int64)[line])
        del line, term
        met_at, place = all_of >> 6, (np.int64(1) << (all_of & 63)).astype(np.int32)
        first = np.flatnonzero(np.diff(met_at, prepend=-1))
        places = np.bitwise_or.reduceat(place, first) if len(first) else place
        row, term = (met_at[first] // n_terms).astype(np.int32), (met_at[first] % n_terms).astype(np.int32)
        del all_of, met_at, place, first
        # One for each entry of a text.
        value = {c: entries[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in names}
        null = {c: entries[c].combine_chunks().is_null().to_numpy(zero_copy_only=False) for c in names}
        by_term = np.lexsort([*value.values(), entry_term])
        count = np.bincount(entry_term, minlength=n_terms)
        each, entry = _spread(np.cumsum(count) - count, count, term)
        entry = by_term[entry]
        row, term, places = row[each], term[each], places[each]
        numbers, unknown = {c: x[entry] for c, x in value.items()}, {c: x[entry] for c, x in null.items()}
        del each, entry
        inside = places & texts > 0
        times = sum((w * (places & bit > 0) for bit, w in weights.items()), np.zeros(len(places)))

        def total(of: np.ndarray, value: np.ndarray, missing: np.ndarray) -> np.ndarray:
            sums = np.bincount(row[of], weights=value[of], minlength=n_rows).astype(np.float64)
            sums[row[of & missing]] = 0.0  # an unknown addend makes the sum of a row 0
            return sums

        out = {key: rows[key], content: rows[content]}
        if conditions:
            tags = (places & tag_place > 0) & (numbers["named"] == 1)
            out[conditions] = _joined(row[tags], term[tags], terms, n_rows)
        for stage in stages:
            sign, no_sign = numbers[stage], unknown[stage]
            side = {s: inside & ~no_sign & (sign == s) for s in (1, -1)}
            out[f"_support_{stage}"] = total(side[1], numbers["weight"], unknown["weight"])
            out[f"_against_{stage}"] = total(side[-1], numbers["weight"], unknown["weight"])
            out[f"_evidence_{stage}"] = total(inside, times * numbers["weight"] * sign, unknown["weight"] | no_sign)
            fields = np.zeros(n_rows, np.int32)
            np.bitwise_or.at(fields, row[side[1]], (places[side[1]] & texts).astype(np.int32))
            out[f"_fields_{stage}"] = fields
            out[f"_hits_{stage}"] = _joined(row[side[1]], term[side[1]], terms, n_rows)
        return pa.table(out)

    return released(sum_up)


def chunks_of(df: DataFrame, texts: Sequence[Column]) -> int:
    """How many chunks the texts make up, by their bytes."""
    size = sum((F.coalesce(F.octet_length(t.cast("string")), F.lit(0)).cast("bigint") for t in texts), F.lit(0))
    n_bytes = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    spread = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // LEAST_BYTES))
    return max(1, spread, -(-n_bytes // CHUNK_BYTES))


def buckets_of(n_terms: int, n_chunks: int) -> int:
    """How many buckets hold the lexicon: few terms in each, and what two chunks ask for."""
    return max(-(-n_chunks // 2), -(-n_terms // BUCKET_TERMS))
