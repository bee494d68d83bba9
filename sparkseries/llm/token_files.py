"""Token files: independent Zstandard frames with a trailing seek table.

Layout of a file (the public seekable format of Zstandard, so any decoder reads it)::

    frame 0 .. frame n-1   independent frames; token ids as little-endian uint32; a document of up to PART_BYTES is in one frame
    document index         skippable frame: compressed (document ids, flags, token counts, entries per frame)
    seek table             skippable frame: per frame (compressed size, size, checksum), footer 0x8F92EAB1

The checksum is the low half of XXH64 over the frame's uncompressed bytes.  The
index has an entry per document and, for a longer document, one per frame that holds
a part of it (flag 2: goes on from the entry before; flag 1: the id
is null).  A reader loads the seek table and the index from the end of the file and then
decompresses only the frames that hold the documents asked for.

Writing: documents are dealt by ranges of the order columns, sorted within a
range and encoded and written there, one file per range, through a temporary name
that is renamed at the end; a task that runs again replaces its file.  Files live
in the shared folder and are opened with pyarrow's file systems.  The driver sees
one row per file.

Encoding goes word by word for tokenizers that drop white space and split on it
(see ``splits_at_space``): the pieces of a word do not depend on its neighbours, so
the library encodes each distinct word once; when more than ``REMEMBERED`` are held,
all are forgotten.  Other tokenizers get whole texts.

Defined cases: null text counts as empty (the end id only); null ids come first;
repeated rows are written each; an empty table writes no file and reads back
empty; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path, ship_package

END_ID = 2
FRAME_BYTES = 1 << 20  # a frame is closed at this size
PART_BYTES = 64 << 20  # what of one document a frame holds at most; a multiple of 4
BATCH_BYTES = 4 << 20
REMEMBERED = 400_000
#: Letters that stay one letter under NFC and lower case.  (U+0130 becomes two characters.)
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and normalize("NFC", c) == c)
#: Words whose letters and marks are pieces of their own.
WORD = f"^(?P<core>[{LETTERS}]+)(?P<marks>[.,;:!?%&*#$]*)$"
# Fixed values of the public Zstandard formats.
SKIPPABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1

_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_space(description: dict) -> bool:
    """Whether a tokenizer's file says that words between white space are encoded apart.

    That holds if the first pre-tokenizer keeps only what its pattern matches, the
    pattern matches no white space, and the normalizers look at single characters
    or at white space (a canonical composition never reaches over a space).  Texts in
    ASCII may be lowered beforehand then.
    """
    pre = description.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    blind = pattern.replace(r"[^\s\p{L}\p{N}]+", "") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|"
    norm = description.get("normalizer") or {"type": "Sequence", "normalizers": []}
    known = any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm])) and all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"}) for n in norm.get("normalizers", [norm]))
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and not any(c.isspace() for c in t["content"]) for t in description.get("added_tokens", []))
    return kept and blind and known and plain and not description.get("truncation") and not description.get("padding")


def closes_words(description: dict) -> bool:
    """Whether the last token of every piece of letters ends in the word suffix and no other token does.

    The alphabet is that of single bytes, written as the library writes them, each with and without the suffix.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    model, steps = description["model"], (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab", {})
    alone = bool(suffix) and all(c in vocab and c + suffix in vocab for c in ByteLevel.alphabet())
    last = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return alone and last and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "ignore_merges"))


class WordEncoder:
    """Texts to token ids (bytes of little-endian uint32).

    Arrow tells a batch's words apart and cuts each distinct one into its letters
    and the marks behind them; any other word stays whole.  The ids of all parts
    met so far lie one after the other in ``pool``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.by_word = splits_at_space(description)
        self.closing = None
        if self.by_word and closes_words(description):
            # Words of LETTERS: lower case is all there is to normalise, and each is one piece.
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = None
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix, vocab = description["model"]["end_of_word_suffix"], description["model"]["vocab"]
            self.closing = np.zeros(max(vocab.values()) + 1, bool)
            self.closing[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.pool, self.bounds = np.zeros(0, "<u4"), np.zeros(2, np.int64)  # ids of place p: pool[bounds[p] : bounds[p + 1]]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); many words share one call, and offsets tell whose a token is."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *[len(w) + 1 for w in words]])
        return np.array(found.ids, "<u4"), np.diff(np.searchsorted([o[0] for o in found.offsets], starts))

    def _ids_of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ``LETTERS``; the last token of a word, and no other, is a closing one."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)

    def _places(self, parts: pa.Array, ids_of) -> np.ndarray:
        """The place of each part; null has place 0, where nothing is."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.places
        new = [w for w in distinct if w not in known]
        blocks = [ids_of(new[at : at + 500]) for at in range(0, len(new), 500)]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        if new:
            self.pool = np.concatenate([self.pool, *[ids for ids, _ in blocks]])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([n for _, n in blocks]))])
        place = np.array([*[known[w] for w in distinct], 0], np.int64)
        return place[pc.fill_null(coded.indices, len(distinct)).to_numpy()]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.by_word:
            texts = texts if isinstance(texts, list) else texts.to_pylist()
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.places) > REMEMBERED:
            self._forget()
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        if self.closing is None:
            parts = self._places(coded.dictionary, self._ids)[:, None]
        else:
            halves = pc.extract_regex(coded.dictionary, WORD)
            core, marks = pc.utf8_lower(pc.struct_field(halves, "core")), pc.struct_field(halves, "marks")
            parts = np.stack([self._places(core, self._ids_of_letters), self._places(pc.coalesce(marks, coded.dictionary), self._ids)], axis=1)
        place = parts[coded.indices.to_numpy()].ravel()
        first = self.bounds[place]
        size = self.bounds[place + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = (ends[parts.shape[1] * words.offsets.to_numpy()] * 4).tolist()
        return [ids[s:e] for s, e in zip(cuts, cuts[1:])]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Writes one file; documents are appended one by one."""

    def __init__(self, sink):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
        self.table, self.held, self.size = [], [], 0
        self.ids, self.flags, self.counts, self.per_frame = array("q"), array("B"), array("I"), array("I")

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        if self.held and self.size + len(tokens) > FRAME_BYTES:
            self._frame()
        for at in range(0, len(tokens) or 1, PART_BYTES):
            if at:
                self._frame()
            part = tokens[at : at + PART_BYTES]
            self.held.append(part)
            self.size += len(part)
            self.ids.append(doc_id or 0)
            self.flags.append((doc_id is None) + 2 * (at > 0))
            self.counts.append(len(part) // 4)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.per_frame.append(len(self.held))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        head = struct.pack("<II", len(self.ids), len(self.per_frame))
        columns = [np.array(c, t).tobytes() for c, t in ((self.ids, "<i8"), (self.flags, "u1"), (self.counts, "<u4"), (self.per_frame, "<u4"))]
        index = self.pack.compress(head + b"".join(columns))
        self.sink.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        self.sink.write(struct.pack("<II", SEEKABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0x80, SEEK_FOOTER))


class TokenFileReader:
    """Reads one file from its end; frames are decompressed on demand and checked."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        table = np.frombuffer(raw, "<u4").reshape(-1, 3)
        ends = np.cumsum(table[:, 0].astype(np.int64))
        self.frames = [(int(e - c), int(c), int(d), int(x)) for e, (c, d, x) in zip(ends, table.tolist())][:-1]
        at, length = int(ends[-1] - table[-1, 0]), int(table[-1, 0])
        index = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length - 8))
        docs, frames = struct.unpack_from("<II", index)
        o = 8
        ids = np.frombuffer(index, "<i8", docs, o)
        o += 8 * docs
        self.flags = np.frombuffer(index, np.uint8, docs, o)
        o += docs
        self.counts = np.frombuffer(index, "<u4", docs, o).astype(np.int64)
        o += 4 * docs
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<u4", frames, o).astype(np.int64))])
        self.ids = [None if f & 1 else i for i, f in zip(ids.tolist(), self.flags.tolist())]
        self.decompressed = 0

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> Iterator[tuple[int, bytes]]:
        """(entry of the index, token bytes) of what frame ``k`` holds."""
        at, packed, size, checksum = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=size)
        self.decompressed += 1
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: checksum differs")
        o = 0
        for d in range(int(self.first[k]), int(self.first[k + 1])):
            n = int(self.counts[d]) * 4
            yield d, raw[o : o + n]
            o += n

    def documents(self, frames: Iterable[int]) -> Iterator[tuple[int, list[bytes]]]:
        """(first entry, parts) of the documents that begin in these frames; all frames of a wanted one must be among them."""
        begun, parts, last = None, [], -1
        for k in frames:
            for d, tokens in self.frame(k):
                if not self.flags[d] & 2:
                    if begun is not None:
                        yield begun, parts
                    begun, parts = d, []
                elif d != last + 1:  # goes on from a frame that was not asked for
                    continue
                parts.append(tokens)
                last = d
        if begun is not None:
            yield begun, parts

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for d, parts in self.documents(range(len(self.frames))):
            yield self.ids[d], b"".join(parts)

    def read(self, wanted: set[int | None]) -> list[tuple[int | None, np.ndarray]]:
        """The documents with these ids, decompressing no frames without them."""
        hits = [d for d, i in enumerate(self.ids) if i in wanted]
        frames = sorted({int(np.searchsorted(self.first, d, side="right")) - 1 for d in hits})
        return [(self.ids[d], np.frombuffer(b"".join(parts), "<u4")) for d, parts in self.documents(frames) if self.ids[d] in wanted]

    def close(self) -> None:
        self.file.close()


def in_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` in which ``column`` has up to ``limit`` bytes, or one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _write(folder: str, tokenizer: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer())
        end = struct.pack("<I", end_id)
        context = TaskContext.get()
        name = f"{folder}/tokens-{context.partitionId():06d}.zst"
        fs, path = open_fs(name)
        writer, total, docs = None, 0, 0
        temporary = f"{path}.{context.taskAttemptId()}.tmp"
        for batch in batches:
            for part in in_bytes(batch, "text", BATCH_BYTES):
                if writer is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(temporary)
                    writer = TokenFileWriter(sink)
                for i, tokens in zip(part.column("id").to_pylist(), encode(part.column("text").fill_null(""))):
                    writer.add(i, tokens + end)
                    total += len(tokens) // 4 + 1
                    docs += 1
        if writer is not None:
            writer.close()
            sink.close()
            if fs.get_file_info(path).type != pafs.FileType.NotFound:  # left by an attempt whose executor was lost
                fs.delete_file(path)
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "file", "n_docs", "n_tokens"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            reader = TokenFileReader(name)
            documents = reader.documents(range(len(reader.frames)))
            while rows := [(reader.ids[d], parts) for d, parts in islice(documents, 2000)]:
                counts = [sum(map(len, parts)) // 4 for _, parts in rows]
                starts = [start, *(start + np.cumsum(counts)).tolist()]
                start = starts.pop()
                sums = [reduce(lambda crc, part: zlib.crc32(part, crc), parts, 0) for _, parts in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([i for i, _ in rows], starts, counts, sums)], ["id", "start", "n_tokens", "ids_crc32"])
            reader.close()


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Write ``docs`` in the given order (ascending id by default); (file, documents, tokens) per file in order."""
    ship_package(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = order or [F.col(id_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[k.alias(f"_k{j}") for j, k in enumerate(keys)])
    keys = [F.col(f"_k{j}").asc_nulls_first() for j in range(len(keys))]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "text")
    done = rows.mapInArrow(_write(folder, tokenizer, end_id), "part int, file string, n_docs long, n_tokens long").collect()
    return [(r["file"], r["n_docs"], r["n_tokens"]) for r in sorted(done, key=lambda r: r["part"])]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]], *, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32; one task per file."""
    rows, start = [], 0
    for name, _, tokens in files:
        rows.append((len(rows), name, start))
        start += tokens
    table = spark.createDataFrame(rows, "k int, file string, start long").repartitionByRange(max(1, len(rows)), "k")
    out = table.select("file", "start").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_round_trip(docs: DataFrame, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and give what reading them back says of each document."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    files = write_token_files(docs, folder, id_col=id_col, text_col=text_col, order=order, tokenizer=tokenizer)
    return read_token_files(spark, files, id_col=id_col)
