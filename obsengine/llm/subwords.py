"""SentencePiece encoding that keeps every piece's place in the source, and decoding.

A text is normalised by the model's own compiled character map: at each place the longest key that the map's
double-array trie holds is replaced, and every byte of the result remembers the source byte at which its replacement
began. Pieces are found in the normalised text by the library's merges, with the library's own normalisation switched
off, and are projected through that alignment to byte ranges of the original.

No piece of most vocabularies holds a space after anything else, so merges never cross the start of a word: a stretch
of spaces and the word behind it are merged once by a worker and kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how a space is written inside pieces
CACHED = 300_000  # stretches that a worker keeps, none longer than LONGEST signs
LONGEST = 64
AT_ONCE = 2_000_000  # source bytes of a batch that leaves a task
UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 2, 3, 4, 5, 6  # kinds of pieces in a model file; 1 is an ordinary one
_kept: dict[str, Model] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else number()
            yield key >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """A compiled map: a size, a double-array trie of the keys' bytes, then the replacements, each ended by a zero byte.

    A unit of the trie is 32 bits: label in the low byte, a flag for a value below it in bit 8, and the distance to its
    children in bits 10 and up, shifted by 8 where bit 9 is set. An empty map replaces nothing.
    """

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest key that stands at `at`, 0 if none, and what replaces it."""
        units, found, value = self.units, 0, 0
        if not units:
            return 0, b""
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return found, self.replacements[value : self.replacements.index(b"\0", value)] if found else b""


class Model:
    """What a model file says of normalisation and pieces, and the library's merges on normalised text."""

    def __init__(self, raw: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces, self.kinds, normal, trained = [], [], [], []
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.kinds.append(piece.get(3, 1))
            elif field == 5 and dict(_fields(value)).get(2):
                raise ValueError("models that change the text after decoding aren't supported")
            elif field in (2, 3):
                (trained if field == 2 else normal).extend(_fields(value))
        spec, train = dict(normal), dict(trained)
        if train.get(24):
            raise ValueError("models that write spaces behind words aren't supported")
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.fallback = bool(train.get(35))
        self.unknown = train.get(44, " ⁇ ".encode())
        self.begin, self.end = train.get(41, 1), train.get(42, 2)
        self.own = sorted((p.encode() for p, k in zip(self.pieces, self.kinds, strict=True) if k == OWN), key=len, reverse=True)
        self.plain = not (self.map.units or self.own or self.squeeze)
        self.cuts = self.escape and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (1, OWN))
        #: Fields 1 to 5 of the normaliser again, of which the last counts: identity, no map, nothing added, squeezed or escaped.
        off = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"
        self.merges = SentencePieceProcessor(model_proto=raw + bytes([3 << 3 | 2, len(off)]) + off)
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.written = [self._written(i) for i in range(len(self.pieces))]
        self.is_byte = [k == BYTE for k in self.kinds]
        self.found: dict[str, bytes] = {}
        self.sized: dict[str, bytes] = {}  # only where unknown stretches have sizes of their own

    def _written(self, i: int) -> bytes:
        """What a piece stands for away from a text's beginning."""
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == CONTROL:
            return b""
        return bytes([int(piece[1:-1], 16)]) if kind == BYTE else self.unknown if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def _part(self, text: bytes, at: int) -> tuple[int, bytes]:
        """How many source bytes go next, and what they become."""
        for own in self.own:
            if text.startswith(own, at):
                return len(own), own
        size, becomes = self.map.longest(text, at)
        if size:
            return size, becomes
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            text[at : at + size].decode()
        except UnicodeDecodeError:
            return 1, "�".encode()
        return size, text[at : at + size]

    def normalise(self, text: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes and its end the source byte at which it begins.

        Bytes that aren't UTF-8 become U+FFFD one by one.
        """
        space = SPACE.encode() if self.escape else b" "
        if not text:
            return "", np.zeros(1, np.int64)
        if self.plain:
            try:
                said = text.decode()
            except UnicodeDecodeError:
                said = None
            if said is not None:
                raw = np.frombuffer(text, np.uint8)
                signs = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw))))
                align = np.repeat(signs, np.where(raw == 32, len(space), 1))
                begin = [0] * (len(space) * self.prefix)
                return (SPACE if self.escape else " ") * self.prefix + (said.replace(" ", SPACE) if self.escape else said), np.concatenate([begin, align, [len(text)]]).astype(np.int64)
        at, out, align = 0, bytearray(), []
        parts = []
        while at < len(text):
            size, becomes = self._part(text, at)
            parts.append((at, becomes))
            at += size
        end = len(text)
        if self.squeeze:
            while parts and parts[0][1] == b" ":
                parts.pop(0)
            if not parts:
                return "", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            align += [parts[0][0]] * len(space)
        blank = self.squeeze
        for at, becomes in parts:
            if blank:
                becomes = becomes.lstrip(b" ")
            if becomes:
                for byte in becomes:
                    piece = space if byte == 32 else bytes([byte])
                    out += piece
                    align += [at] * len(piece)
                blank = self.squeeze and becomes.endswith(b" ")
        while self.squeeze and out.endswith(space):
            end = align[len(out) - len(space)]
            del out[-len(space) :], align[-len(space) :]
        return out.decode(), np.array([*align, end], np.int64)

    def _merge(self, stretches: list[str]) -> list[tuple[bytes, bytes | None]]:
        """Ids of each stretch and, where unknown pieces take their sizes from the text, the pieces' bytes."""
        if self.fallback:
            return [(_raw(i), None) for i in self.merges.encode(stretches, num_threads=1)]
        protos = [self.merges.encode(s, return_type="proto") for s in stretches]
        return [(_raw([p.id for p in m.pieces]), _raw([len(p.surface.encode()) for p in m.pieces])) for m in protos]

    def _cut(self, text: str) -> list[str]:
        """Keys of a text's stretches of spaces and the word behind them: one that begins with a space goes without it.

        Spaces are plain in keys, so the written space, which no key holds otherwise, marks a stretch that begins with none.
        """
        if not self.cuts:
            return [SPACE + text] if text else []
        text = text.replace(SPACE, " ")
        if text.startswith(" ") and not text.endswith(" ") and "  " not in text:
            return text.split(" ")[1:]
        return [s[1:] if s.startswith(" ") else SPACE + s for s in re.findall(" *[^ ]+| +", text)]

    def _whole(self, key: str) -> str:
        if not self.cuts:
            return key[1:]
        return (key[1:] if key.startswith(SPACE) else SPACE + key).replace(" ", SPACE)

    def ids(self, normalised: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Of each normalised text the ids as little-endian unsigned 32-bit numbers, and the pieces' bytes."""
        stretches = [self._cut(t) for t in normalised]
        if len(self.found) > CACHED:
            self.found.clear()
            self.sized.clear()
        new = list(set().union(*stretches) - self.found.keys())
        once = []
        for stretch, (ids, sizes) in zip(new, self._merge(list(map(self._whole, new))), strict=True):
            self.found[stretch] = ids
            if sizes is not None:
                self.sized[stretch] = sizes
            if len(stretch) > LONGEST:
                once.append(stretch)
        out = []
        for own in stretches:
            raw = b"".join(map(self.found.__getitem__, own))
            sizes = self.sizes[np.frombuffer(raw, "<u4")] if self.fallback else np.frombuffer(b"".join(map(self.sized.__getitem__, own)), "<u4").astype(np.int64)
            out.append((raw, sizes))
        for stretch in once:
            del self.found[stretch]
            self.sized.pop(stretch, None)
        return out

    def encode(self, texts: list[bytes], begin: bool = True, end: bool = True) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """Ids, first bytes and ends of the pieces' source ranges, with the begin and end ids at the text's two ends."""
        normal = [self.normalise(t) for t in texts]
        first, last = (np.array([i], "<u4").tobytes() if wanted else b"" for i, wanted in ((self.begin, begin), (self.end, end)))
        out = []
        for text, (_, align), (raw, sizes) in zip(texts, normal, self.ids([n for n, _ in normal]), strict=True):
            edges = align[np.concatenate([[0], np.cumsum(sizes)])]
            starts = np.concatenate([[0] * begin, edges[:-1], [len(text)] * end]).astype("<u4")
            ends = np.concatenate([[0] * begin, edges[1:], [len(text)] * end]).astype("<u4")
            out.append((first + raw + last, starts, ends))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of some ids. The first space goes where the model adds one; bytes that make no UTF-8 are U+FFFD each."""
        at = 0
        strip = self.prefix or self.squeeze
        lead = b""
        while strip and at < len(ids) and not self.is_byte[ids[at]]:
            piece = self.written[ids[at]]
            spaced = self.kinds[ids[at]] not in (CONTROL, UNKNOWN) and piece.startswith(b" ")
            lead = piece[spaced:]
            at += 1
            if lead or spaced and not self.squeeze:
                break
        parts = [lead, *map(self.written.__getitem__, ids[at:])]
        out = b"".join(parts)
        try:
            out.decode()
        except UnicodeDecodeError:
            return self._mended(parts[1:], ids[at:], lead)
        return out

    def _mended(self, parts: list[bytes], ids: list[int], lead: bytes) -> bytes:
        """The same with runs of byte pieces read sign by sign; other pieces are whole signs, so runs stand for themselves."""
        out, run = [lead], bytearray()

        def close() -> None:
            i = 0
            while i < len(run):
                size = next((k for k in range(1, 5) if _sign(bytes(run[i : i + k]))), 0)
                out.append(bytes(run[i : i + size]) if size else "�".encode())
                i += size or 1
            run.clear()

        for part, i in zip(parts, ids, strict=True):
            if self.is_byte[i]:
                run.extend(part)
            else:
                close()
                out.append(part)
        close()
        return b"".join(out)


def _raw(numbers: list[int]) -> bytes:
    return struct.pack(f"<{len(numbers)}I", *numbers)


def _sign(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def model(path: str) -> Model:
    """The model of a file, read once a worker."""
    if path not in _kept:
        with open(path, "rb") as f:
            _kept[path] = Model(f.read())
    return _kept[path]


def slices(batch: pa.RecordBatch, text: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text, a row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, packed: bool = False, decoded: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, ids, starts, ends[, decoded])` of every whole text, a row for each row, the ids as the sentencepiece library has them.

    Piece i stands for the source's UTF-8 bytes from `starts[i]` up to `ends[i]`. The ranges follow one another; of a
    sign that falls apart into byte pieces the last has the range and the others are empty, as are the begin and end
    ids. `ids`, `starts` and `ends` are arrays of int, or with `packed` binaries of little-endian unsigned 32-bit numbers. Null and empty texts
    have the begin and end ids alone. Repeated rows are encoded each, null doc_ids are kept, other columns are left
    aside whatever their names, and an empty table gives an empty result. `path` must open on every executor.
    `decoded` adds what the ids decode to: as `decode` has it, without a second worker that holds the model.
    """

    kind = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = own.encode([t or b"" for t in batch.column(1).to_pylist()], begin, end)
                columns = [[np.frombuffer(r[0], "<u4") for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
                arrays = [pa.array([x.tobytes() if packed else x.astype(np.int32) for x in c], kind) for c in columns]
                if decoded:
                    arrays.append(pa.array([own.decode(x.tolist()).decode() for x in columns[0]], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "ids", "starts", "ends", "decoded"][: 1 + len(arrays)])

    said = "binary" if packed else "array<int>"
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id long, ids {said}, starts {said}, ends {said}" + ", decoded string" * decoded)


def decode(tokens: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`tokens` with the text of its ids, an array of int or a binary as `encode` packs it; a column `to` is replaced.

    Null ids give null; no ids give the empty text. Ids outside the vocabulary are refused.
    """
    read = F.col(ids)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        own = model(path)
        return column.map(lambda x: None if x is None else own.decode((np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.asarray(x, np.int64)).tolist()).decode())

    return tokens.withColumn(to, text(read))
