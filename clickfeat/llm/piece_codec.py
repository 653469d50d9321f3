"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

A model file of the sentencepiece library (kind BPE) is read once on the driver; tasks get its bytes (some hundred kB).

* **Normalising.** At each place the longest prefix that the model's compiled character map (a double-array trie) holds
  is replaced; a character it does not hold stays, a byte that is no UTF-8 becomes U+FFFD. White space becomes ``U+2581``,
  one of them is put in front. Every byte of the result records the source byte it came from, so the text need not
  be kept beside it.
* **Pieces.** Neighbouring symbols are merged, best score first and leftmost among equals. Where no piece of
  the vocabulary holds two neighbouring characters in a row, nothing can merge across them: texts are cut there (before
  white space, around line breaks, before punctuation after a letter), each distinct part is encoded once per task and remembered within a byte bound.
  Symbols outside the vocabulary become byte pieces.
* **Spans.** The lengths of the pieces in the normalised text are added up and looked up in the alignment: begin and end
  (bytes of the original text) of every piece; of a character in byte pieces the last one has the span.
* **Decoding.** Pieces and bytes are put together, the white space in front is taken off, wrong bytes become U+FFFD.

Not supported (raises): other kinds of models, user-defined or unused pieces, white space as suffix, denormalising maps.
Odd input: null and empty texts have the end id alone and decode to an empty text; null, equal and repeated ids each
keep their row; one part of any length is merged in n log n steps; other columns of ``docs`` are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textops as tx
from .common import as_bytes, documents

SPACE = "▁"
_MARK = SPACE.encode()
_WRONG = "�".encode()
#: Bytes of parts and characters that a task remembers, and the longest part it does.
REMEMBER_BYTES, LONGEST_PART = 64 << 20, 64
#: Up to this many symbols the best pair is looked for anew after every merge.
SHORT = 20
_NEVER = float("inf")


def character(data: bytes, at: int) -> int:
    """Bytes of the UTF-8 character at ``at``; 0 if there is none."""
    b = data[at]
    n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    try:
        data[at:at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n if len(data) - at >= n else 0


class CharacterMap:
    """The compiled map: byte length of a double-array trie, the trie (32-bit units), replacements ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest prefix of ``data[at:]`` in the map."""
        if not self.units:
            return None
        found, node, end = None, self._child(0), at
        while end < len(data):
            node ^= data[end]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[end]:
                break
            has_value = self.units[node] >> 8 & 1
            node ^= self._child(node)
            end += 1
            if has_value:
                found = self.units[node] & 0x7FFFFFFF, end - at
        if found is None:
            return None
        return self.texts[found[0]:self.texts.index(b"\0", found[0])], found[1]

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("white space as suffix, unescaped white space and denormalising maps are not supported")
        self.map, self.squeeze, self.prefix = CharacterMap(spec.precompiled_charsmap), spec.remove_extra_whitespaces, spec.add_dummy_prefix
        self.ids, self.ranks, self.bytes, self.out, self.special = {}, {}, {}, [], set()
        self.unknown, self.end = 0, proto.trainer_spec.eos_id
        for i, p in enumerate(proto.pieces):
            text = p.piece.replace(SPACE, " ").encode()
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.ranks[p.piece] = i, -p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.CONTROL:
                self.special.add(i)
                text = b""
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                text = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
            else:
                raise ValueError("user-defined and unused pieces are not supported")
            self.out.append(text)
        self.byte_ids = set(self.bytes.values())
        self.size = np.array([len(p.piece.encode()) for p in proto.pieces])
        self.is_byte = np.zeros(len(self.out), bool)
        self.is_byte[list(self.byte_ids)] = True
        self.size[self.is_byte] = 1
        self.follows = self.is_byte.copy()  # byte pieces inside a character
        self.follows[[i for b, i in self.bytes.items() if b & 0xC0 != 0x80]] = False
        if len(self.bytes) not in (0, 256):
            raise ValueError("some byte pieces are missing")
        self.parts = self._cuts({p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)})
        self.known: dict[str, tuple] = {}
        self.left = REMEMBER_BYTES

    @staticmethod
    def _cuts(pairs: set[str]) -> re.Pattern | None:
        """Parts of a normalised text between which no piece of the vocabulary (its ``pairs`` of neighbours) can stand."""
        if any(p[0] != SPACE and p[1] == SPACE for p in pairs):
            return None  # pieces go on over white space: one part
        letters = {c for p in pairs for c in p}
        alone = "".join(re.escape(c) for c in "\t\n\r\x0b\x0c" if c not in letters)
        # punctuation that binds with no ASCII letter or digit before it, and what other characters it does bind with
        marks = {m for m in string.punctuation if not any(p[1] == m and p[0].isascii() and p[0].isalnum() for p in pairs)}
        binding = "".join(re.escape(c) for c in sorted({p[0] for p in pairs if p[1] in marks and p[0] not in marks and p[0] != SPACE}))
        mark = "[" + "".join(map(re.escape, sorted(marks))) + "]" if marks else "(?!)."
        other = f"[^{SPACE}{alone}" + "".join(map(re.escape, sorted(marks))) + "]"
        more = f"(?:(?<=[{binding}]){mark}+{other}*)*" if binding else ""
        return re.compile((f"[{alone}]|" if alone else "") + f"(?=.){SPACE}*{mark}*{other}*{more}", re.DOTALL)

    # --- normalising

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, source byte of each of its bytes and the end) of any bytes."""
        out, at = [], []
        pos, n = 0, len(data)

        def take(pos):
            got = self.map.longest(data, pos)
            if got is None:
                size = character(data, pos)
                got = (data[pos:pos + size], size) if size else (_WRONG, 1)
            return got
        if self.squeeze:
            while pos < n:
                text, size = take(pos)
                if text != b" ":
                    break
                pos += size
        if pos == n:
            return b"", np.array([n] if n else [0])
        if self.prefix:
            out.append(_MARK)
            at += [pos] * len(_MARK)
        after_space = self.squeeze
        while pos < n:
            text, size = take(pos)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                marked = text.replace(b" ", _MARK)
                out.append(marked)
                at += [pos] * len(marked)
                after_space = text.endswith(b" ")
            pos += size
            after_space = after_space and self.squeeze
        text, last = b"".join(out), n
        while self.squeeze and text.endswith(_MARK):
            text = text[:-len(_MARK)]
            last = at[len(text)]
        return text, np.array([*at[:len(text)], last])

    def _plain(self, data: bytes) -> tuple[str, np.ndarray] | None:
        """:meth:`normalize` where no character is mapped and no white space goes; None where it does not apply."""
        if self.map.units or self.squeeze or not data:
            return None
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        size = np.where(np.frombuffer(data, np.uint8) == 32, len(_MARK), 1)
        at = np.repeat(np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64), size)
        front = np.zeros(len(_MARK) if self.prefix else 0, np.int64)
        return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([front.astype(at.dtype), at, np.array([len(data)], at.dtype)])

    # --- pieces

    def merged(self, part: str) -> list[str]:
        """The symbols of ``part`` after all merges."""
        ranks = self.ranks
        s = list(part)
        if len(s) <= SHORT:
            get = ranks.get
            near = [get(part[i:i + 2], _NEVER) for i in range(len(s) - 1)]
            while near and (best := min(near)) != _NEVER:
                at = near.index(best)
                s[at:at + 2] = (whole := s[at] + s[at + 1]),
                del near[at]
                if at:
                    near[at - 1] = get(s[at - 1] + whole, _NEVER)
                if at < len(near):
                    near[at] = get(whole + s[at + 1], _NEVER)
            return s
        before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap = [(r, i, len(s[i]) + len(s[i + 1])) for i in range(len(s) - 1) if (r := ranks.get(s[i] + s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not s[i] or j < 0 or len(s[i]) + len(s[j]) != size or s[i] + s[j] not in ranks:
                continue
            s[i], s[j] = s[i] + s[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(s[a] + s[b])) is not None:
                    heapq.heappush(heap, (r, a, len(s[a]) + len(s[b])))
        return [x for x in s if x]

    def _encode_part(self, part: str) -> tuple:
        """ids of a part."""
        ids, symbols = self.ids, self.merged(part)
        try:
            return tuple([ids[x] for x in symbols])
        except KeyError:
            pass
        out = []
        for x in symbols:
            out += [ids[x]] if x in ids else [self.bytes[b] for b in x.encode()] if self.bytes else [self.unknown]
        return tuple(out)

    def _part(self, part: str) -> tuple:
        got = self._encode_part(part)
        if len(part) <= LONGEST_PART:
            if self.left < 0:
                self.known.clear()
                self.left = REMEMBER_BYTES
            self.known[part] = got
            self.left -= 250 + 8 * len(got)
        return got

    def _sizes(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Bytes of the normalised text in each piece."""
        sizes = self.size[ids]
        if not self.bytes:  # an unknown piece is one character
            wide = [len(c.encode()) for c in text if c not in self.ids]
            sizes[ids == self.unknown] = wide
        return sizes

    def encode(self, data: bytes, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and begin and end of each piece in the bytes of the original text; the end id stands at its end."""
        plain = self._plain(data)
        if plain is None:
            raw, at = self.normalize(data)
            text = raw.decode()
        else:
            text, at = plain
        parts = self.parts.findall(text) if self.parts else [text] if text else []
        known = self.known
        ids = np.fromiter(chain.from_iterable([known.get(p) or self._part(p) for p in parts]), np.int32)
        sizes = self._sizes(ids, text)
        if not self.bytes and len(ids) > 1:  # neighbouring unknown symbols are one piece
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            sizes = np.add.reduceat(sizes, np.flatnonzero(first))
            ids = ids[first]
        stops = np.cumsum(sizes)
        starts = stops - sizes
        follows = self.follows[ids]
        if follows.any():  # the last byte piece of a character has its span, the others have no width
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(ids))))
            starts = starts[lead]
            inner = np.append(follows[1:], False) & self.is_byte[ids]
            stops = np.where(inner, starts, stops)
        begin, stop = at[starts], at[stops]
        if end:
            ids, begin, stop = np.append(ids, np.int32(self.end)), np.append(begin, len(data)), np.append(stop, len(data))
        return ids, begin, stop

    # --- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library puts it together."""
        out = self.out
        text = b"".join([out[i] for i in ids])
        try:
            return self._without_lead(ids, text).decode()
        except UnicodeDecodeError:
            pass
        parts, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_ids:
                run += out[i]
                continue
            pos = 0
            while pos < len(run):
                size = character(bytes(run[pos:pos + 4]), 0)
                parts.append(bytes(run[pos:pos + size]) if size else _WRONG)
                pos += size or 1
            run.clear()
            if i >= 0:
                parts.append(out[i])
        return self._without_lead(ids, b"".join(parts)).decode()

    def _without_lead(self, ids: list[int], text: bytes) -> bytes:
        """``text`` without the white space that was put in front (all of it where the model squeezes white space)."""
        if not (self.prefix or self.squeeze):
            return text
        for i in ids:
            if i in self.special:
                continue
            if i in self.byte_ids or i == self.unknown or not self.out[i].startswith(b" "):
                break
            text = text[1:]
            if not self.squeeze or self.out[i] != b" ":
                break
        return text


_codecs: dict[bytes, Codec] = {}


def codec(blob: bytes) -> Codec:
    """The codec of a model, built once per worker process."""
    name = hashlib.sha256(blob).digest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(blob)
    return _codecs[name]


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(kind)))


def _encode(blob: bytes, spans: bool, decoded: bool):
    def run(batches):
        c = codec(blob)
        for batch in batches:
            for lo, hi, data, offsets in tx.text_chunks(batch):
                ids, begins, ends, texts, covered = [], [], [], [], []
                raw, cuts = data.tobytes(), offsets.tolist()
                for a, b in zip(cuts, cuts[1:]):
                    i, begin, end = c.encode(raw[a:b])
                    ids.append(i)
                    covered.append(int((end - begin).sum()))
                    if spans:
                        begins.append(begin)
                        ends.append(end)
                    if decoded:
                        texts.append(c.decode(i.tolist()))
                out = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": _lists(ids, np.int32)}
                if spans:
                    out |= {"begins": _lists(begins, np.int64), "ends": _lists(ends, np.int64)}
                if decoded:
                    out["decoded"] = pa.array(texts, pa.string())
                yield pa.record_batch(out | {"covered_bytes": pa.array(covered, pa.int64())})
    return run


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: bytes, spans: bool = True, decoded: bool = False) -> DataFrame:
    """Of every row of ``docs``: doc_id, ids (the end id last), with ``spans`` begins and ends of the pieces in the bytes of
    the text, with ``decoded`` the text that the ids decode to, and covered_bytes, the summed widths of the spans."""
    schema = "doc_id long, ids array<int>, " + "begins array<long>, ends array<long>, " * spans + "decoded string, " * decoded + "covered_bytes long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    return rows.mapInArrow(_encode(model, spans, decoded), schema)


def _decode(blob: bytes, keep: list[str]):
    def run(batches):
        c = codec(blob)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])
    return run


def decode_pieces(rows: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids`` with the text that the ids decode to (null ids: null)."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(model, ["doc_id", "ids"]), "doc_id long, ids array<int>, decoded string")


def op13_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (equal to the text's bytes: no byte is lost)."""
    if model_path is None:
        import public_tokenizers
        model_path = str(public_tokenizers.path("piece_bpe_32k.model"))
    got = encode_pieces(documents(spark, sf_dir), read_model(model_path), spans=False, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "covered_bytes")
