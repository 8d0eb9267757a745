"""Loads public tokenizers on the executors, once for each Python worker; nothing here is trained."""

from __future__ import annotations

import base64
import functools

import regex

#: Code points on which the pattern below, in `regex` and in `tiktoken`, splits exactly as the JSON vocabulary's own
#: pre-tokenizer does; newer or rarer ones differ by Unicode version, and texts with them go the library's own way.
PLAIN = regex.compile("[\x00-՗ -⁰₠-₿℀-⅏←-⏿─-➿　-ゖ゠-ヺ一-鿯가-힣\U0001f300-\U0001f64f]*")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def special_ids(path: str) -> dict[str, int]:
    """The added special strings, which the library finds inside texts by default."""
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@functools.lru_cache(4)
def ranks(path: str):
    """The same vocabulary as `tiktoken` has it: the same ids, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


@functools.lru_cache(4)
def splitter():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def plain(text: str, path: str) -> bool:
    """Whether the fast ways give the library's own result for the text."""
    return PLAIN.fullmatch(text) is not None and not any(s in text for s in special_ids(path))


def encoded(text: str, path: str) -> list[int]:
    """The ids of a whole text as the tokenizers library gives them with add_special_tokens=False."""
    if path.endswith("byte_bpe_50k.json") and plain(text, path):
        return ranks(path.removesuffix("json") + "tiktoken").encode_ordinary(text)
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def pre_tokens(text: str, path: str) -> list[str]:
    """The pieces that merges can't cross; an added special string is a piece of its own."""
    if plain(text, path):
        return splitter().findall(text)
    out, specials = [], special_ids(path)
    for part in regex.split("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")", text) if specials else [text]:
        if part in specials:
            out.append(part)
        elif part:
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    return out
