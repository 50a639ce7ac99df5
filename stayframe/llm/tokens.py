"""Token ids in Arrow stream files of equal-length sequences.

Documents in ascending doc_id order become one stream of ids, cut into shards by ranges of doc_id and, per shard, into
sequences of a fixed length. A shard is an Arrow stream whose batches hold a fixed-size list of ids and one of mask bits
per sequence, so a memory-mapped reader gets any sequence without copying. Only a shard's last sequence is padded. Beside it lies
a second stream with the place of every document. Both are written under another name and moved, so a task that runs
again replaces its files by equal ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayframe.llm.stored import stored
from stayframe.llm.words import Texts, distinct_spans, find_words, summed_by_text, text_blocks

SEQUENCE_LENGTH = 2048
SEQUENCES_PER_BATCH = 256
#: The id appended to every document.
END_ID = 1
#: Pieces of text whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text whose distinct pieces are looked up together.
BLOCK_BYTES = 8 << 20
#: Unknown pieces encoded together.
TOGETHER = 4096


#: Pieces of text: what stands between spaces and line breaks.
_PIECE_BYTES = ~np.isin(np.arange(256), [32, 10])


class PieceEncoder:
    """Ids of texts, piece by piece: what stands between two spaces or line breaks is encoded once and remembered.

    That equals encoding the whole text with a tokenizer that collapses white space and never joins across it.
    """

    def __init__(self, path: str, id_type: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.dtype(id_type)
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(own.ids, dtype=self.id_type) for own in found]

    def _learn_words(self, words: list[bytes]) -> None:
        """Lower-case words of letters only: one pre-token each, whose last id is the only one that ends a word."""
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            ids = self._ids([b" ".join(own).decode()])[0]
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.id_type.itemsize
            if len(ends) == len(own):
                joined = ids.tobytes()
                cuts = ends.tolist()
                self.known.update(zip(own, (joined[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self.known.update(zip(own, (ids.tobytes() for ids in self._ids([word.decode() for word in own])), strict=True))

    def _full(self, new: list[bytes]) -> bool:
        return len(self.known) + len(new) > (REMEMBERED if self.remembered is None else self.remembered)

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces that are not known."""
        if self._full(new):
            self.known.clear()
        known = self.known
        # Bytes are alphabetic, or lower case, by ASCII letters only: most pieces are words as they stand.
        words = {piece for piece in new if piece.isalpha() and piece.islower()}
        others = [piece for piece in new if piece not in words]
        composed = [(piece, split) for piece in others if (split := _core(piece)) is not None]
        words.update(split[0] for _, split in composed if split[0] and split[0] not in known)
        self._learn_words(sorted(words))
        split_ones = {piece for piece, _ in composed}
        plain = [piece for piece in others if piece not in split_ones]
        plain += [mark for mark in {split[1] for _, split in composed} if mark and mark not in known]
        for at in range(0, len(plain), TOGETHER):
            own = plain[at : at + TOGETHER]
            known.update(zip(own, (ids.tobytes() for ids in self._ids([p.decode() for p in own])), strict=True))
        for piece, (word, mark) in composed:
            known[piece] = (known[word] if word else b"") + (known[mark] if mark else b"")

    def _pieces(self, texts: Texts) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Per piece of a block its number; per number the ids, as bytes; and where each text's pieces start and end.

        Each distinct piece of the block is looked up once.
        """
        words = find_words(texts, _PIECE_BYTES)
        first, piece_of = distinct_spans(texts.data, words.starts, words.ends)
        data = texts.data.tobytes()
        pieces = [data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        found = [self.known.get(piece) for piece in pieces]
        new = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if new:
            kept = dict(zip(pieces, found, strict=True)) if self._full(new) else {}
            self._learn(new)
            found = [ids if ids is not None else self.known[piece] for piece, ids in zip(pieces, found, strict=True)]
            self.known.update((piece, ids) for piece, ids in kept.items() if ids is not None)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.id_type.itemsize
        return piece_of, found, lengths, words.bounds

    def count(self, texts: Texts) -> np.ndarray:
        """How many ids every text of a block has."""
        piece_of, _, lengths, bounds = self._pieces(texts)
        return summed_by_text(lengths[piece_of], bounds)

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """The ids of every text of a block."""
        piece_of, found, lengths, bounds = self._pieces(texts)
        if not len(piece_of):
            return [np.zeros(0, dtype=self.id_type)] * len(texts)
        table = np.frombuffer(b"".join(found), dtype=self.id_type)
        starts = np.cumsum(lengths) - lengths
        own = lengths[piece_of]
        ends = np.cumsum(own)
        ids = table[np.repeat(starts[piece_of] - (ends - own), own) + np.arange(int(own.sum()))]
        cuts = np.concatenate([[0], ends])[bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _core(piece: bytes) -> tuple[bytes, bytes] | None:
    """A piece as lower-case word and one mark after it, either of which may be empty; None if it is anything else."""
    mark = piece[-1:] if piece[-1:] in (b".", b",") else b""
    word = piece[: len(piece) - len(mark)]
    if word.isalpha():  # bytes: ASCII letters only
        return word.lower(), mark
    if not word:
        return b"", mark
    text = word.decode()
    # Letters of Latin-1 have one lower-case letter each and no other composed form.
    if text.isalpha() and max(text) < "Ā" and "µ" not in text and "ª" not in text and "º" not in text:
        return text.lower().encode(), mark
    return None


def public_tokenizer(name: str) -> str:
    """The path of a tokenizer file that is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[tuple[str, str, int | None], PieceEncoder] = {}


def encoder(path: str, id_type: str, remembered: int | None = None) -> PieceEncoder:
    """The encoder of this Python process."""
    key = path, id_type, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


@dataclass(frozen=True)
class SequenceFormat:
    """Length of a sequence, sequences per batch, and the type of ids."""

    length: int = SEQUENCE_LENGTH
    per_batch: int = SEQUENCES_PER_BATCH
    id_type: str = "uint16"

    def schema(self) -> pa.Schema:
        ids = pa.list_(pa.from_numpy_dtype(self.id_type), self.length)
        return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), self.length))])

    def batch(self, ids: np.ndarray, used: int) -> pa.RecordBatch:
        """Whole sequences; the mask tells the first ``used`` ids from padding."""
        mask = pa.array(np.arange(len(ids)) < used)
        columns = [pa.FixedSizeListArray.from_arrays(values, self.length) for values in (pa.array(ids), mask)]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema())


class _MovedWhenDone:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{attempt}.part"
        self.sink = self.fs.open_output_stream(self.temporary)

    def close(self) -> None:
        self.sink.close()
        self.fs.move(self.temporary, self.path)


class SequenceWriter:
    """Appends documents to a shard; holds one batch of ids."""

    def __init__(self, uri: str, index_uri: str, form: SequenceFormat, key: pa.DataType, attempt: int):
        self.form = form
        self.files = [_MovedWhenDone(uri, attempt), _MovedWhenDone(index_uri, attempt)]
        self.index_schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.ids_out = pa.ipc.new_stream(self.files[0].sink, form.schema())
        self.index_out = pa.ipc.new_stream(self.files[1].sink, self.index_schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = self.n_docs = 0

    def add(self, keys: pa.Array, documents: Sequence[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, documents), dtype=np.int64, count=len(documents))
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.index_out.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(lengths)], schema=self.index_schema))
        self.waiting += documents
        self.n_waiting += int(lengths.sum())
        self.n_tokens += int(lengths.sum())
        self.n_docs += len(documents)
        full = self.form.length * self.form.per_batch
        if self.n_waiting >= full:
            ids = np.concatenate(self.waiting)
            for at in range(0, len(ids) - full + 1, full):
                self.ids_out.write_batch(self.form.batch(ids[at : at + full], full))
            rest = ids[len(ids) // full * full :].copy()
            self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> None:
        if self.n_waiting:
            ids = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(ids) // self.form.length) * self.form.length, dtype=self.form.id_type)
            padded[: len(ids)] = ids
            self.ids_out.write_batch(self.form.batch(padded, len(ids)))
        self.ids_out.close()
        self.index_out.close()
        for file in self.files:
            file.close()


def shard_uri(path: str, shard: int) -> tuple[str, str]:
    return f"{path}/shard-{shard:06d}.arrows", f"{path}/shard-{shard:06d}.index.arrows"


def write_sequences(docs: DataFrame, path: str, tokenizer: str, form: SequenceFormat | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode the whole ``text`` of every row and write shards below ``path``; returns one row per shard.

    ``tokenizer`` names a tokenizer file that every executor has. Rows are ordered by doc_id (nulls first), rows with
    equal doc_ids by a hash of their text, and equal rows by their place, so that neither one repeated doc_id nor one
    repeated row is a shard that cannot be parted. A null text is empty: its document has the end id alone. Returned: shard, path, n_docs, n_tokens, and ``start``, the ids of earlier shards.
    """
    form = form or SequenceFormat()

    def per_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        own = encoder(tokenizer, form.id_type)
        end = np.array([end_id], dtype=form.id_type)
        writer = None
        for batch in batches:
            if writer is None:
                writer = SequenceWriter(*shard_uri(path, shard), form, batch.column(0).type, context.taskAttemptId())
            for texts in text_blocks(batch.column(1), BLOCK_BYTES):
                keys = batch.column(0)[texts.first : texts.first + len(texts)]
                writer.add(keys, [np.concatenate([ids, end]) for ids in own.encode(texts)])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    ties = [F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place")]
    ordered = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"), *ties)
        .repartitionByRange("doc_id", "tie", "place")
        .sortWithinPartitions("doc_id", "tie", "place")
        .select("doc_id", "text")
    )
    shards = stored(ordered.mapInArrow(per_shard, "shard int, path string, n_docs long, n_tokens long"), "token-shards")
    # One row per shard.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def open_stream(uri: str) -> pa.ipc.RecordBatchStreamReader:
    """A reader over a shard's file; memory-mapped, so batches are views, where the file system is the machine's own."""
    fs, path = pafs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    return pa.ipc.open_stream(source)


class MappedSequences:
    """Random access to the sequences of one memory-mapped shard."""

    def __init__(self, uri: str):
        _, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path)
        self.schema = pa.ipc.open_stream(self.source).schema
        self.source.seek(0)
        pa.ipc.read_message(self.source)
        self.offsets: list[int] = []
        self.ends: list[int] = []
        total = 0
        while True:
            at = self.source.tell()
            try:
                message = pa.ipc.read_message(self.source)
            except EOFError:
                break
            total += pa.ipc.read_record_batch(message, self.schema).num_rows
            self.offsets.append(at)
            self.ends.append(total)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, sequence: int) -> tuple[np.ndarray, pa.Array]:
        """Ids, as a view of the file, and mask of a sequence."""
        k = int(np.searchsorted(self.ends, sequence, side="right"))
        self.source.seek(self.offsets[k])
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        row = sequence - (self.ends[k - 1] if k else 0)
        length = batch.column(0).type.list_size
        first = row * length
        return batch.column(0).values.to_numpy()[first : first + length], batch.column(1).values[first : first + length]


def _stored_ids(uri: str) -> Iterator[np.ndarray]:
    """The ids of a shard, batch by batch, without padding."""
    for batch in open_stream(uri):
        used = batch.column(1).values.true_count
        yield batch.column(0).values.to_numpy()[:used]


def fold_documents(uri: str, index_uri: str, step: Callable[[int, np.ndarray], int]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Index batches of a shard, each with the outcome of ``step`` over its documents' ids, which come in parts."""
    parts = _stored_ids(uri)
    current = np.zeros(0, dtype=np.uint16)
    for batch in open_stream(index_uri):
        outcome = []
        for needed in batch.column(2).to_pylist():
            state = 0
            while needed:
                if not len(current):
                    current = next(parts)
                state = step(state, current[:needed])
                taken = min(needed, len(current))
                current, needed = current[taken:], needed - taken
            outcome.append(state)
        yield batch, outcome


def read_checksums(shards: DataFrame, key_type: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""

    def add(state: int, ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes(), state)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards_batch in batches:
            for shard in shards_batch.to_pylist():
                for batch, checksums in fold_documents(*shard_uri(shard["path"], shard["shard"]), add):
                    starts = pa.array(batch.column(1).to_numpy() + shard["start"])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), starts, batch.column(2), pa.array(checksums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A shard per task, whatever the shards' rows weigh.
    return shards.repartition(shards.count() or 1, "shard").mapInArrow(
        per_task, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    )
