"""Token ids of whole texts by the tokenizers library, fast for vocabularies of words.

Where the tokenizer drops white space and works on each stretch between it alone (its
vocabulary marks word ends), equal stretches have equal ids. Those are encoded once and
kept in a bounded cache in the worker, so a text costs one lookup per word. Any other
tokenizer encodes each text whole. Both give the ids that the library gives.
"""

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distinct stretches a worker remembers; then it keeps those that came again, up to half.
# Speed only, never results.
CACHED_WORDS = 1_000_000
WORD_END = "</w>"
# Every ASCII mark but the apostrophe, which may begin a contraction.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Below it no letter joins another, and lower case has one letter.
LETTERS_END = "\u0250"

_TOOLS: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


# 1: a to z; 2: a mark; 4: the first byte of a letter of two bytes; 8: the rest of one.
BYTE_KINDS = np.zeros(256, np.uint8)
BYTE_KINDS[ord("a"):ord("z") + 1] = 1
BYTE_KINDS[list(MARKS)] = 2
BYTE_KINDS[0xC3:0xC9] = 4
BYTE_KINDS[0x80:0xC0] = 8
# Multiplication and division signs, and a capital whose lower case has a mark of its own.
NO_LETTERS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def marks_apart(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered texts with a space between a letter of low code point and a mark after it."""
    kinds = BYTE_KINDS.take(text)
    at = np.flatnonzero((kinds == 2)[1:] & (kinds[:-1] & 9 > 0)) + 1
    # Before a byte that goes on, the letter is told by both of its bytes; where a text of
    # one byte begins, there is none, and the last byte is not one that goes on.
    long = kinds.take(at - 1) == 8
    first, second = text.take(at - 2, mode="clip"), text.take(at - 1)
    letter = BYTE_KINDS.take(first) == 4
    for pair in NO_LETTERS:
        letter &= (first != pair[0]) | (second != pair[1])
    at = at[~long | letter]
    out = np.insert(text, at, ord(" "))
    return out, edges + np.searchsorted(at, edges)


class WordNumbers(dict):
    """Numbers words in the order they come, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file; built once per worker."""
    if path not in _TOOLS:
        _TOOLS[path] = Encoder(path)
    return _TOOLS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        # The same model on words that are normalized and spelled in bytes.
        self.by_space = Tokenizer(self.tool.model)
        self.by_space.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        with open(path, encoding="utf-8") as file:
            self.by_word = json.load(file)["model"].get("end_of_word_suffix") == WORD_END
        added = self.tool.get_added_tokens_decoder().values()
        special = [t.content for t in added if t.special]
        self.apart = special[0] if special else None
        self.added = [t.content.lower().encode() for t in added]
        # A stretch of a to z needs no normalizing or splitting; ask the model at once. So
        # for other letters of low code points, in lower case and spelled in bytes.
        self.direct = all(
            self.model_ids(w) == self.whole(w).tolist()
            for w in ("a", "the", "zqx", "internationalization"))
        letters = [c for c in map(chr, range(0x80, ord(LETTERS_END))) if self.low_letters(c)]
        self.wide = self.direct and all(
            self.model_ids(w.lower().encode().decode("latin-1").translate(BYTE_LETTERS))
            == self.whole(w).tolist() for w in [*letters, "".join(letters)])
        # A run of marks after letters is a stretch of its own.
        every = MARKS.decode()
        self.apart_marks = all(
            self.whole(w + m).tolist() == self.whole(w).tolist() + self.whole(m).tolist()
            for w in ("a", "zqx", "é") for m in [*every, every])
        self.forget()

    def forget(self):
        self.words = WordNumbers()
        self.words[b""] = 0  # stands before and after white space, and has no ids
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        # In how many calls each word came since the last time some were dropped.
        self.seen = np.zeros(1 << 14, np.int32)

    def drop(self):
        """Keep the words that came again, up to half of all."""
        keep = np.flatnonzero(self.seen[:len(self.words)] > 1)
        keep = keep[np.argsort(-self.seen[keep], kind="stable")[:CACHED_WORDS // 2]]
        keep = keep[keep != self.words[b""]]
        all_words = list(self.words)
        kept = [all_words[k] for k in keep.tolist()]
        ids, ends = self.ids_at(keep)
        sizes = np.diff(ends)
        self.forget()
        self.words.update(zip(kept, range(1, len(kept) + 1), strict=True))
        numbers = np.arange(1, len(kept) + 1)
        self.store(numbers, ids, sizes)
        self.seen[numbers] = 1

    def low_letters(self, text: str) -> bool:
        """Whether a text is letters of low code points, and so in lower case."""
        return text.isalpha() and (low := text.lower()).isalpha() and max(low) < LETTERS_END

    def model_ids(self, text: str) -> list[int]:
        return [t.id for t in self.tool.model.tokenize(text)]

    def lowered(self, text: str) -> bytes | None:
        """The text with A to Z in lower case, or None if that changes ids.

        The library composes marks before it lowers case; where neither form of the text
        has anything to compose, the order does not matter. It takes added tokens out before
        either, so a text that may hold one, in any case of letters, is left to it.
        """
        lowered = text.encode().lower()
        if any(token in lowered for token in self.added):
            return None
        if not text.isascii() and not (
                unicodedata.is_normalized("NFC", text)
                and unicodedata.is_normalized("NFC", lowered.decode())):
            return None
        return lowered

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts in a row, and how many each text has.

        Equal stretches of these texts are looked up once; marks after a letter of low code
        point are stretches of their own.
        """
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = b"".join(texts)
        if self.apart_marks and data:
            data, edges = marks_apart(np.frombuffer(data, np.uint8), edges)
        stretches = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(
            len(texts), pa.py_buffer(edges), pa.py_buffer(data)))
        coded = stretches.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        row = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
        words = pc.binary_join(row, pa.scalar(b"\n", pa.large_binary()))[0].as_py().split(b"\n")
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self.room(len(self.words))
        self.seen[numbers] += 1
        return numbers[coded.indices.to_numpy()], pc.list_value_length(stretches).to_numpy()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each."""
        if not self.by_word:
            each = [self.whole(t) for t in texts]
            return (np.concatenate([np.zeros(0, np.uint32), *each]),
                    np.array([len(e) for e in each], np.int64))
        plain, apart = [], {}
        for k, text in enumerate(texts):
            lowered = self.lowered(text)
            if lowered is None:
                apart[k] = self.whole(text)
            plain.append(lowered or b"")
        numbers, counts = self.numbered(plain)
        self.learn()
        ids, ends = self.ids_at(numbers)
        edges = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        lengths = np.diff(edges)
        if apart:
            parts = [apart.get(k, ids[edges[k]:edges[k + 1]]) for k in range(len(texts))]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if len(self.words) > CACHED_WORDS:
            self.drop()
        return ids, lengths

    def learn(self):
        """Find the ids of the words that came for the first time.

        Letters with marks after them have the ids of both. Letters of low code points are
        asked of the model. Other words of letters are encoded many in a row and told apart
        by their one token that ends a word, others by a special token between them; where
        the number of tokens shows that a row does not come apart so, it is encoded word by
        word.
        """
        new, self.words.new = self.words.new, []
        find, joined, whole = self.words.__getitem__, [], []
        number = len(self.words) - len(new)
        for word in new:
            stem = word.rstrip(MARKS) if self.apart_marks else word
            if stem and len(stem) < len(word) and stem.decode().lower().isalpha():
                joined.append((number, find(stem), find(word[len(stem):])))
            else:
                whole.append((number, word))
            number += 1
        whole += [(number + k, w) for k, w in enumerate(self.words.new)]
        self.words.new = []
        self.room(len(self.words))
        direct, rest = [], []
        for number, word in whole:
            if self.direct and word.isalpha():
                direct.append((number, word.decode()))
            elif self.wide and self.low_letters(text := word.decode()):
                direct.append(
                    (number, text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)))
            else:
                rest.append((number, word.decode()))
        for k in range(0, len(direct), 4096):
            numbers, row = zip(*direct[k:k + 4096], strict=True)
            ids = self.row_ids(" ".join(row), self.by_space)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(row):
                each = [self.model_ids(w) for w in row]
                cuts = np.cumsum([len(i) for i in each])
                ids = np.array([i for one in each for i in one], np.uint32)
            self.store(np.array(numbers, np.int64), ids, np.diff(cuts, prepend=0))
        whole = rest
        plain = [w for w in whole if w[1].isalpha()]
        other = [w for w in whole if not w[1].isalpha()]
        for k in range(0, len(plain), 512):
            row = plain[k:k + 512]
            ids = self.row_ids(" ".join(t for _, t in row), self.tool)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            self.keep(row, ids, np.diff(cuts, prepend=0) if len(cuts) == len(row) else None)
        for k in range(0, len(other), 512):
            row, sizes = other[k:k + 512], None
            ids = np.zeros(0, np.uint32)
            if self.apart:
                ids = self.row_ids(f" {self.apart} ".join(t for _, t in row), self.tool)
                between = ids == self.tool.token_to_id(self.apart)
                cuts = np.append(np.flatnonzero(between), len(ids))
                if len(cuts) == len(row):
                    sizes = np.diff(cuts, prepend=-1) - 1
                    ids = ids[~between]
            self.keep(row, ids, sizes)
        if joined:
            at, stems, marks = np.array(joined, np.int64).T
            parts = np.stack([stems, marks], 1).ravel()
            self.store(at, self.ids_at(parts)[0], self.sizes[stems] + self.sizes[marks])

    def row_ids(self, text: str, tool) -> np.ndarray:
        return np.array(tool.encode_batch_fast(
            [text], add_special_tokens=False)[0].ids, np.uint32)

    def keep(self, row: list[tuple[int, str]], ids: np.ndarray, sizes: np.ndarray | None):
        """Store a row's ids; without sizes the row is encoded word by word."""
        if sizes is None:
            each = self.tool.encode_batch_fast([t for _, t in row], add_special_tokens=False)
            sizes = np.array([len(e.ids) for e in each], np.int64)
            ids = np.array([i for e in each for i in e.ids], np.uint32)
        self.store(np.array([n for n, _ in row], np.int64), ids, sizes)

    def room(self, words: int):
        while words > len(self.starts):
            self.starts, self.sizes, self.seen = (
                np.concatenate([x, np.zeros_like(x)])
                for x in (self.starts, self.sizes, self.seen))

    def store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.room(len(self.words))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[numbers] = sizes
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def ids_at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered words in a row, and where each word begins and the last ends."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        spread = np.repeat(self.starts[numbers] - ends[:-1], sizes)
        spread += np.arange(ends[-1])
        return self.flat[spread], ends


def batches(texts: list[str | None], most: int = 1 << 22):
    """Runs of texts of about ``most`` characters, as (first, texts); null is empty."""
    first, run, size = 0, [], 0
    for k, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run
