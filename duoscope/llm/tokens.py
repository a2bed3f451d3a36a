"""Token ids as the public tokenizer files give them, fast enough for whole corpora.

``byte_ids`` rebuilds a byte-level BPE file as a rank table for tiktoken, which gives the ids of the
tokenizers library (special strings in a text are matched, none is added) in a sixth of its time; texts
with a very long run of white space, at which tiktoken's pattern gives up, go to the library.
``word_ids`` keeps the ids of white-space separated words and of the pieces they are cut into, as the
tokenizers library gave them, and hands every text that holds more than printable Latin-1 to it whole. Files with
other rules than these two are built for are left to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

Encoder = Callable[[list[str]], list[np.ndarray]]

#: How a byte-level BPE file cuts a text into pieces (fixed value of that format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for BPE with word ends, each piece encoded by itself up to an id that ends it (fixed value of that format).
WORD_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


#: Characters of white space in a row that tiktoken is given: its pattern keeps a place to go back to for each, a million at most.
RUN = 100_000


def long_run(text: str) -> bool:
    """Whether ``text`` holds over ``RUN`` characters of white space in a row."""
    return len(text) > RUN and any(m.end() - m.start() > RUN for m in re.finditer(r"\s+", text))


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the tokenizer file: counts stored under another version are never used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def byte_ids(path: str) -> Encoder:
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): k for piece, k in file["model"]["vocab"].items() if piece not in special}
    coder = tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    @lru_cache(maxsize=1)
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def ids(t: str) -> np.ndarray:
        if long_run(t):
            return np.asarray(library().encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(coder.encode_to_numpy(t, allowed_special="all"), dtype=np.uint32)

    return lambda texts: [ids(t) for t in texts]


@lru_cache(maxsize=4)
def word_ids(path: str, held: int = 1_000_000) -> Encoder:
    """``held`` bounds the words and the pieces a task keeps; beyond it the memory of them starts anew."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch
    pieces = regex.compile(WORD_PIECES).findall
    memo: dict[str, bytes] = {}  # a word's ids as little-endian 32-bit numbers
    known: dict[str, bytes] = {}  # and a piece's
    last = np.zeros(library.get_vocab_size(), dtype=bool)
    last[[k for token, k in library.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(texts: list[str]) -> list[np.ndarray]:
        for kept in (memo, known):
            if len(kept) > held:
                kept.clear()
        split = [t.lower().split() if plain(t) and "<|" not in t else None for t in texts]
        fresh = [w for w in set().union(*(x for x in split if x is not None)) if w not in memo]
        cut = [pieces(w) for w in fresh]
        unseen = [p for p in set().union(*cut) if p not in known]
        for k in range(0, len(unseen), 8192):
            part = unseen[k : k + 8192]
            lines = [" ".join(part[j : j + 64]) for j in range(0, len(part), 64)]
            ids = np.array([x for e in library.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], dtype="<u4")
            ends = (np.flatnonzero(last[ids]) + 1) * 4
            data, begins = ids.tobytes(), [0, *ends[:-1].tolist()]
            known.update((p, data[a:z]) for p, a, z in zip(part, begins, ends.tolist(), strict=True))
        memo.update((w, b"".join(map(known.__getitem__, c))) for w, c in zip(fresh, cut, strict=True))
        out = []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(np.asarray(library.encode(t, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype=np.uint32))
        return out

    return encode


@lru_cache(maxsize=4)
def piece_ids(path: str) -> Encoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [np.asarray(x, dtype=np.uint32) for x in model.encode(texts, num_threads=1)] if texts else []


@lru_cache(maxsize=4)
def library_ids(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda texts: [np.asarray(e.ids, dtype=np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def plain_model(file: dict) -> bool:
    """Whether a BPE file has no rule beyond its merges, and special tokens that match wherever they stand."""
    m = file["model"]
    odd = [m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")]
    special = [t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    return m.get("type") == "BPE" and not any(odd) and not any(special) and not file.get("truncation") and not file.get("padding")


def is_byte_level(file: dict) -> bool:
    """Whether ``byte_ids`` holds for a file: text cut by ``PIECES``, merges in the order of their ids, after all bytes."""
    pre, m = file.get("pre_tokenizer") or {}, file["model"]
    if not plain_model(file) or file.get("normalizer") or m.get("end_of_word_suffix"):
        return False
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    made = [m["vocab"].get("".join(x.split(" ") if isinstance(x, str) else x)) for x in m["merges"]]
    singles = [k for t, k in m["vocab"].items() if len(t) == 1]
    return len(singles) == 256 and None not in made and made == sorted(set(made)) and max(singles) < made[0] and len(made) + 256 == len(m["vocab"])


def is_word_level(file: dict) -> bool:
    """Whether ``word_ids`` holds for a file: white space folded, lower case, pieces by ``WORD_PIECES`` with an end mark."""
    normal, pre = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [{}, {}])
    split = cuts[0].get("pattern", {}).get("Regex") == WORD_PIECES and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    bytes_ = len(cuts) == 2 and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and cuts[1].get("use_regex") is False
    return plain_model(file) and steps == ["NFC", "Replace", "Lowercase"] and split and bytes_ and file["model"].get("end_of_word_suffix") == "</w>"


def encoder(path: str) -> Encoder:
    """By kind of file: sentencepiece models, byte-level BPE, BPE with word ends, anything else."""
    if path.endswith(".model"):
        return piece_ids(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return byte_ids(path) if is_byte_level(file) else word_ids(path) if is_word_level(file) else library_ids(path)


def vocabulary(path: str) -> int:
    """One more than the largest id."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return 1 + max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
