"""Exact calls of public tokenizers inside tasks, once for each distinct word of a batch.

Both BPE files cut a text into runs before merging, and no run spans certain white
space. A word's tokens then depend on the word alone: a batch's words are made a
dictionary by Arrow, each distinct word is encoded once, and the texts' tokens are
gathered by numpy. Texts for which that argument does not hold go to the library whole.
"""

from __future__ import annotations

import json
import os
from hashlib import sha256
from importlib.metadata import version

import numpy as np

#: Words joined into one text for the library.
JOINED = 64
#: Letters below U+0130, whose class and case are the same in every version of Unicode.
_LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]"
#: A superset of what any of the libraries takes as white space.
_SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_version(name: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(tokenizer_path(name), "rb") as f:
        return sha256(f"{library} {version(library)}\n".encode() + f.read()).hexdigest()


def _load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(tokenizer_path(name), encoding="utf-8") as f:
        return Tokenizer.from_file(tokenizer_path(name)), json.load(f)


def word_codes(lists):
    """(dictionary of distinct words, code of each word, offsets of the texts) of an Arrow array of lists of words."""
    flat = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _edges(tok, of) -> np.ndarray:
    table = np.zeros(tok.get_vocab_size() + 1, bool)
    for token, i in tok.get_vocab().items():
        table[i] = of(token)
    return table


class _WordTable:
    """Ids of distinct words, each as if it stood alone between spaces.

    A word of plain letters is one run of the tokenizer's pattern, whatever stands around it, so
    many go to the library as one text; the ids are cut where ``edge`` marks a token as the first
    (or last) of a word. A comma or full stop after plain letters is a run of its own.
    """

    def __init__(self, tok, edge: np.ndarray, first: bool, lower: bool):
        self.tok, self.edge, self.first, self.lower = tok, edge, first, lower
        self.marks = {m: np.array(tok.encode(f"a{m}", add_special_tokens=False).ids[1:], np.int64) for m in (",", ".")}

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        lead = " " if self.first else ""
        made = [e.ids for e in self.tok.encode_batch_fast([lead + w for w in words], add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], np.int64), np.array([len(x) for x in made], np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lead, made = " " if self.first else "", [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, enc in zip(groups, self.tok.encode_batch_fast([lead + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(enc.ids)
            cuts = np.flatnonzero(self.edge[ids]) + (not self.first)
            cuts = np.append(cuts, len(ids)) if self.first else np.append(0, cuts)
            whole = len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == len(ids)
            made.append((ids, np.diff(cuts)) if whole else self._alone(group))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def ids(self, words) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the words' offsets in them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(words)
        plain = pc.match_substring_regex(words, f"^{_LETTERS}+[,.]?$").to_numpy(zero_copy_only=False)
        core = pc.replace_substring_regex(words.filter(pa.array(plain)), "[,.]$", "")
        core = (pc.utf8_lower(core) if self.lower else core).dictionary_encode()
        base, base_size = self._joined(core.dictionary.to_pylist())
        rest, rest_size = self._alone(words.filter(pa.array(~plain)).to_pylist())
        pool_ids = np.concatenate((base, rest, self.marks[","], self.marks["."]))
        pool_size = np.concatenate((base_size, rest_size, [len(self.marks[","]), len(self.marks["."])]))
        pool_at = np.cumsum(pool_size) - pool_size
        # Each word is one entry of the pool, and a mark's entry after it or an empty one.
        entry, mark = np.empty(n, np.int64), np.full(n, -1)
        entry[plain] = core.indices.to_numpy(zero_copy_only=False)
        entry[~plain] = len(base_size) + np.arange(len(rest_size))
        for m, k in ((",", 2), (".", 1)):
            mark[plain & pc.ends_with(words, m).to_numpy(zero_copy_only=False)] = len(pool_size) - k
        n_mark = np.where(mark >= 0, pool_size[mark], 0)
        both_at = np.stack([pool_at[entry], pool_at[mark]], 1).ravel()
        both_n = np.stack([pool_size[entry], n_mark], 1).ravel()
        return gather(pool_ids, both_at, both_n), np.concatenate(([0], np.cumsum(pool_size[entry] + n_mark)))


def gather(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``data[at[i]:at[i] + n[i]]`` for each i, one after the other."""
    ends = np.cumsum(n)
    return data[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class TokenCounter:
    """Number of tokens of texts, as the library counts them."""

    def __init__(self, name: str):
        self._table = None
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
            self._whole = lambda texts: [len(model.encode(t)) for t in texts]
            return
        tok, conf = _load(name)
        self._whole = lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        pre = conf["pre_tokenizer"] or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not conf["normalizer"]:
            self._special = [t["content"] for t in conf["added_tokens"]]
            # A piece is what follows a space, with the space; only a word's first token starts with one (as U+0120).
            self._table = _WordTable(tok, _edges(tok, lambda t: t.startswith("\u0120")), True, False)

    def count_all(self, texts) -> np.ndarray:
        """``texts``: Arrow strings without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self._table is None:
            return np.array(self._whole(texts.to_pylist()), np.int64)
        # A space between two other spaces changes how their run is cut, and special strings cut a text first.
        apart = pc.match_substring_regex(texts, f"{_SPACE} {_SPACE}")
        for special in self._special:
            apart = pc.or_(apart, pc.match_substring(texts, special))
        counts = np.zeros(len(texts), np.int64)
        alone = apart.to_numpy(zero_copy_only=False)
        if alone.any():
            counts[alone] = self._whole(texts.filter(apart).to_pylist())
        rest = texts.filter(pc.invert(apart))
        if len(rest):
            words, codes, at = word_codes(pc.split_pattern(rest, " "))
            _, offsets = self._table.ids(words)
            n = np.diff(offsets)[codes]
            n[at[:-1]] = 0  # a text's first piece has no space before it
            firsts = self._whole(words.take(pa.array(codes[at[:-1]])).to_pylist())
            counts[~alone] = np.add.reduceat(n, at[:-1]) + np.array(firsts)
        return counts


class WordEncoder:
    """Token ids of texts, for vocabularies of lower-case words that drop white space.

    Any cut at ASCII white space is safe with them; other white space stays inside a word, which
    then goes to the library.
    """

    def __init__(self, name: str):
        tok, conf = _load(name)
        steps = [n.get("type") for n in (conf["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or conf["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{name} isn't a vocabulary of lower-case words with word ends")
        self._table = _WordTable(tok, _edges(tok, lambda t: t.endswith("</w>")), False, True)

    def encode_all(self, texts, together: int = 500):
        """Ids of each text as an array; ``texts``: Arrow strings without nulls."""
        import pyarrow.compute as pc

        words, codes, at = word_codes(pc.ascii_split_whitespace(texts))
        ids, offsets = self._table.ids(words)
        ids, size = ids.astype("<u4"), np.diff(offsets)
        for i in range(0, len(texts), together):
            ends = at[i : i + together + 1]
            some = codes[ends[0] : ends[-1]]
            n = size[some]
            made, cum = gather(ids, offsets[some], n), np.concatenate(([0], np.cumsum(n)))
            cuts = cum[ends - ends[0]]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield made[a:b]
