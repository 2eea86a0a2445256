"""Byte-level BPE from a ``tokenizers`` JSON file, on the fast path where that is exact.

When the file is plain byte-level BPE whose merge order equals its id order, the same
vocabulary runs as ranks in ``tiktoken``, several times faster; any other file, and any
text the fast path refuses, goes through ``tokenizers`` itself.  Special tokens that occur
in a text become their ids, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

# The pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Unicode's white space, and letters, digits and marks that have long been such.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ώА-яёа-џぁ-ゖァ-ヺ一-龥가-힣"
_DIGIT = "0-9"
_MARK = "!-&(-/:-@\\[-`{-~、。「-】，．：；！？（）…—–“”‘’«»¿¡·"

#: Places where a pre-token ends whatever stands around, so that both sides are encoded as they are
#: within the whole: before white space that follows something else, and between letters, digits and
#: marks.  A mark may take the letters after it along only if it is an apostrophe.
SAFE = re.compile(
    rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}{_DIGIT}])"
)


def safe_between(left: str, right: str) -> bool:
    """Whether a pre-token surely ends where two texts meet."""
    return bool(left) and bool(right) and SAFE.match(left[-1] + right[0], 1) is not None


#: A run of white space this long goes to ``tokenizers``: the fast path's regex gives up on it.
LONG_SPACE = 50_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file.  Ids come as unsigned 32-bit arrays."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.fast = self._fast(spec)

    @functools.cached_property
    def exact(self):
        """The file in ``tokenizers``, loaded only if a text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _fast(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE"
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
        )
        if not plain:
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        order = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(order, order[1:])) or len(order) != len(vocab) - 256:
            return None
        as_byte = byte_alphabet()
        ranks = {bytes(as_byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, exactly those of ``tokenizers``."""
        if self.fast is not None and not _refused(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def whole(self, text: str) -> bool:
        """Whether a text must be encoded as a whole: a special token's string in it cuts pre-tokens."""
        return any(k in text for k in self.special)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        if self.fast is not None:
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")
        return self.exact.decode(ids.tolist(), skip_special_tokens=False)


def _refused(text: str) -> bool:
    if len(text) < LONG_SPACE:
        return False
    return re.search(r"\s{%d}" % LONG_SPACE, text) is not None


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One encoder per file and process."""
    return ByteBpe(path)


def default_path() -> str:
    """The vocabulary the queries use; operators take any other as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
