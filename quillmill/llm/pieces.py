"""SentencePiece encoding with the bytes of the source behind every piece, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from quillmill.llm.bpe import NEVER, PART_BITS, SHORT, Memory, PairTable, merged, merged_rows
from quillmill.llm.tables import batches_mapped

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
MEMORY = 300_000
TOGETHER = 64  # texts whose results are held at a time
# piece types of the model file (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled character map of a model file: longest prefix to replacement.

    The map is a double-array trie over UTF-8 bytes followed by the replacements, each
    ended by a zero byte. A unit's low byte is its label, bit 8 says that a value follows,
    bits 10 on are the offset to the children, in steps of 256 if bit 9 is set.
    """

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    @staticmethod
    def children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that starts at ``at``."""
        node = self.children(self.units[0])
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self.children(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found


class Encoded(NamedTuple):
    """Ids of a text, the range of source bytes that each stands for, and the ids in decimal."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    line: str


class Word(NamedTuple):
    """An encoded word: its ids with their widths in bytes 32 bits higher up, packed, and the ids in decimal."""

    packed: bytes
    line: str


class Pieces:
    """A byte pair model of the SentencePiece kind, from the bytes of its file.

    ``encode`` gives the ids the library gives. As no piece holds a blank mark behind
    another character (checked here), merges never cross the start of a word, so words are
    encoded one by one and remembered, at most twice ``MEMORY`` of them.
    """

    def __init__(self, blob: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.escape_whitespaces is False:
            raise ValueError("only byte pair models with marked blanks are read")
        if model.denormalizer_spec.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that rewrite decoded text or mark word ends are not read")
        self.charmap = rules.precompiled_charsmap
        self.dummy_prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.surface = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("models with user defined or unused pieces are not read")
        self.order = {p: -model.pieces[i].score for p, i in self.ids.items()}
        bytes_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)] if bytes_of else None
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids or [])}
        self.plain_bytes = [
            bytes([self.byte_of[i]]) if kind == BYTE else p.replace(BLANK, " ").encode() if kind == NORMAL else None
            for i, (p, kind) in enumerate(zip(self.surface, self.kinds, strict=True))
        ]
        self.unknown, self.end = model.trainer_spec.unk_id, model.trainer_spec.eos_id
        self.unknown_surface = model.trainer_spec.unk_surface
        self.single = not self.charmap and not self.squeeze and self.dummy_prefix
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.single &= not crossing
        self._number_parts()
        self.words = re.compile("(?s).+" if crossing else f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def _number_parts(self) -> None:
        """Numbers for pieces and single characters, and the table of the pairs that merge.

        Only runs of blank marks may share a score; a word with such a run, and any word of a model
        with other pieces of one score, is merged on its own.
        """
        # a character that is no piece has a number behind all pieces
        self.unlisted = len(self.surface)
        self.widths = np.array([len(p.encode()) for p in self.surface], np.int64)
        self.decimal = [str(i) for i in range(self.unlisted)]
        ranks = {score: i for i, score in enumerate(sorted(set(self.order.values())))}
        plain = [p for p in self.ids if p.strip(BLANK) or len(p) < 2]
        self.pairs: PairTable | None = None
        if len({self.order[p] for p in plain}) == len(plain) and self.unlisted + 0x110000 < 1 << PART_BITS:
            found = [
                (self.part(p[:cut]), self.part(p[cut:]), ranks[self.order[p]] << PART_BITS | i)
                for p, i in self.ids.items() for cut in range(1, len(p))
            ]
            whole = [x for x in found if x[0] is not None and x[1] is not None]
            self.pairs = PairTable(*map(list, zip(*whole, strict=True))) if whole else None

    def part(self, text: str) -> int | None:
        """The number of a piece or a single character; None for any other text."""
        found = self.ids.get(text)
        return self.unlisted + ord(text) if found is None and len(text) == 1 else found

    @cached_property
    def numbers(self) -> Memory:
        """Numbers of the characters met."""
        return Memory(self.part, 0x110000)

    def learn(self, texts: list[str]) -> None:
        """Encode the new words of ``texts`` together, and remember them.

        These are the short words behind single blanks; what else a text holds is encoded when it is met.
        """
        if self.pairs is None or not self.single:
            return
        words = {w for t in texts for w in t.split(" ") if 0 < len(w) < SHORT and BLANK not in w}
        new = sorted(self.known_marked.unmet(words), key=len)
        number = self.numbers
        for begin in range(0, len(new), 2048):  # of about equal lengths
            part = new[begin : begin + 2048]
            sizes = np.array([len(w) + 1 for w in part])
            rows = np.zeros((len(part), int(sizes[-1])), np.int64)
            rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = [number[c] for w in part for c in BLANK + w]
            rows, sizes = merged_rows(rows, sizes, self.pairs)
            inside = np.arange(rows.shape[1])[None, :] < sizes[:, None]
            known = ((rows < self.unlisted) | ~inside).all(axis=1)
            packed = rows | self.widths[np.minimum(rows, self.unlisted - 1)] << 32
            blank = len(BLANK.encode()) - 1
            packed[:, 0] -= blank << 32
            for word, ids, row, size, fine in zip(part, rows.tolist(), packed, sizes.tolist(), known.tolist(), strict=True):
                if fine:
                    made = Word(row[:size].tobytes(), " ".join([self.decimal[i] for i in ids[:size]]))
                else:
                    characters = [self.surface[i] if i < self.unlisted else chr(i - self.unlisted) for i in ids[:size]]
                    made = self.listed(characters, blank)
                self.known_marked.put(word, made)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "known_marked", "numbers")}

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is cut into pieces, and for each of its bytes, and its end, the source byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        source, charmap = text.encode(), CharacterMap(self.charmap) if self.charmap else None
        out, align, at = [], [], 0
        while at < len(source):
            found = charmap.longest(source, at) if charmap else None
            if found is None:
                lead = source[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = width, source[at : at + width]
            width, put = found
            straight = put == source[at : at + width]
            for i, byte in enumerate(put):
                out.append(byte)
                align.append(at + i if straight else at)
            at += width
        if self.squeeze:
            keep = [
                i for i, b in enumerate(out) if b != 32 or (i and out[i - 1] != 32 and any(x != 32 for x in out[i:]))
            ] if 32 in out else range(len(out))
            out, align = [out[i] for i in keep], [align[i] for i in keep]
        if not out:
            return "", np.zeros(1, np.int64)
        mark = BLANK.encode()
        data, sources = [], []
        if self.dummy_prefix:
            data += mark
            sources += [align[0]] * 3
        for byte, a in zip(out, align, strict=True):
            data += mark if byte == 32 else [byte]
            sources += [a] * (3 if byte == 32 else 1)
        return bytes(data).decode(errors="replace"), np.array([*sources, len(source)])

    def word_pieces(self, word: str) -> list[str]:
        """The pieces of a word after all merges; what the vocabulary lacks stays a character."""
        order = self.order
        return merged(list(word), lambda a, b: order.get(a + b, NEVER))

    def word(self, word: str, blank: int = 0) -> Word:
        """A word with its mark, encoded; ``blank`` bytes less are counted for its first piece."""
        return self.listed(self.word_pieces(word), blank)

    def listed(self, pieces: list[str], blank: int) -> Word:
        """The same from the word's merged pieces."""
        ids, widths = [], []
        for piece in pieces:
            found = self.ids.get(piece)
            size = len(piece) if piece.isascii() else len(piece.encode())
            if found is not None:
                ids.append(found)
                widths.append(size)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
                widths += [1] * size
            elif ids and ids[-1] == self.unknown:
                widths[-1] += size
            else:
                ids.append(self.unknown)
                widths.append(size)
        widths[0] -= blank
        packed = array("q", [i | w << 32 for i, w in zip(ids, widths, strict=True)])
        return Word(packed.tobytes(), " ".join(map(str, ids)))

    def marked_word(self, word: str) -> Word:
        """A word that follows a single blank, with the blank's mark counted as one byte."""
        return self.word(BLANK + word, len(BLANK.encode()) - 1)

    @cached_property
    def known(self) -> Memory:
        """Words met before; a worker keeps it from task to task."""
        return Memory(self.word, MEMORY)

    @cached_property
    def known_marked(self) -> Memory:
        """Words behind a single blank met before."""
        return Memory(self.marked_word, MEMORY)

    def encode(self, text: str) -> Encoded:
        """Ids of a text without begin and end ids, each with its range of source bytes.

        The prefix blank that the model adds stands for no source byte. Where the text is
        only marked, not rewritten, and its blanks stand alone, widths add up to source
        bytes; any other text is projected through its alignment.
        """
        single = self.single and text and text[0] != " " and text[-1] != " " and "  " not in text
        if single and BLANK not in text:
            words = list(map(self.known_marked.__getitem__, text.split(" ")))
        else:
            normal, align = self.normalized(text)
            words = list(map(self.known.__getitem__, self.words.findall(normal)))
        packed = np.frombuffer(b"".join([w.packed for w in words]), np.int64)
        edges = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(packed >> 32, out=edges[1:])
        if single and BLANK not in text:
            edges = np.maximum(edges - 1, 0)
            starts, ends = edges[:-1], edges[1:]
        else:
            starts, ends = align[edges[:-1]], align[edges[1:]]
        return Encoded(
            packed.astype(np.int32), starts, np.maximum(starts, ends), " ".join([w.line for w in words])
        )

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library decodes them: control ids are silent, bytes that
        make no character become replacement characters, and the prefix blank goes."""
        body = ids[:-1] if ids and ids[-1] == self.end else ids
        try:  # whole pieces and whole characters only: the bytes just follow each other
            plain = b"".join(map(self.plain_bytes.__getitem__, body)).decode()
        except (TypeError, UnicodeDecodeError):
            return self.decode_runs(ids)
        strip = (self.dummy_prefix or self.squeeze) and body and body[0] not in self.byte_of
        return plain[1:] if strip and plain.startswith(" ") else plain

    def decode_runs(self, ids: list[int]) -> str:
        """The same id by id."""
        out: list[bytes] = []
        run = bytearray()
        first = self.dummy_prefix or self.squeeze

        def flush() -> None:
            if run:
                out.append(mended(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            if self.kinds[i] == CONTROL:
                continue
            piece = self.unknown_surface if self.kinds[i] == UNKNOWN else self.surface[i].replace(BLANK, " ")
            if first and not any(out):
                first = False
                if self.kinds[i] != UNKNOWN and piece.startswith(" "):
                    piece = piece[1:]
            out.append(piece.encode())
        flush()
        return b"".join(out).decode()


def mended(data: bytes) -> bytes:
    """UTF-8 bytes with every byte outside a whole character replaced."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = b"", 0
        while at < len(data):
            for width in (4, 3, 2, 1):
                part = data[at : at + width]
                try:
                    if len(part) == width and len(part.decode()) == 1:
                        break
                except UnicodeDecodeError:
                    continue
            else:
                width, part = 1, "�".encode()
            out += part
            at += width
        return out


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


ENCODED = "ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_pieces(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """Ids, source byte ranges and decoded text of every whole text in ``docs``.

    All columns of ``docs`` but the text stay (those named like a new one are replaced);
    added are ids (the text's, then the end id), starts and ends (bytes of the source text
    behind each id; the end id stands at the end) and decoded. With ``digest`` only doc_id
    stays and the results are n_tokens, ids_sha256 and decoded_sha256. No shuffle; the
    model, of a fixed size, is broadcast. A null text counts as an empty one, which has the
    end id only.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_bytes(path or public_tokenizers.path(MODEL))))
    new = {"text"} if digest else {"text", "ids", "starts", "ends", "decoded"}
    kept = ["doc_id"] if digest else [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), DIGEST if digest else ENCODED])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = digest_columns if digest else encoded_columns
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                found = make(pieces.value, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found.values()], [*kept, *found])

    return batches_mapped(docs.select(*kept, "text"), encode, schema)


def digest_columns(model: Pieces, texts: list[str]) -> dict[str, pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of texts."""
    rows = []
    model.learn(texts)
    for text in texts:
        found = model.encode(text)
        line = f"{found.line} {model.end}" if found.line else str(model.end)
        decoded = model.decode([*found.ids.tolist(), model.end])
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (line, decoded))
        rows.append((len(found.ids) + 1, *digests))
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}


def encoded_columns(model: Pieces, texts: list[str]) -> dict[str, pa.Array]:
    """ids, starts, ends and decoded of texts; lists go from numpy to Arrow, never through objects."""
    parts: dict[str, list[np.ndarray]] = {"ids": [], "starts": [], "ends": []}
    decoded, sizes = [], [0]
    model.learn(texts)
    for text in texts:
        found = model.encode(text)
        size = len(text.encode())
        for name, own, last in (("ids", found.ids, model.end), ("starts", found.starts, size), ("ends", found.ends, size)):
            parts[name].append(np.append(own, last).astype(np.int32))
        decoded.append(model.decode(parts["ids"][-1].tolist()))
        sizes.append(len(found.ids) + 1)
    offsets = pa.array(np.cumsum(sizes), pa.int32())
    lists = {name: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for name, x in parts.items()}
    return lists | {"decoded": pa.array(decoded, pa.string())}
