"""Where vocabulary files are; a parameter of every operator that needs one."""

from __future__ import annotations

import os


def path(name: str) -> str:
    """Full path of a vocabulary file, or ``name`` itself if it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict = {}


def hf(name: str):
    """The tokenizers library's tokenizer, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (key := ("hf", name)) not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path(name))
        t.no_truncation()
        t.no_padding()
        _LOADED[key] = t
    return _LOADED[key]


def sp(name: str):
    if (key := ("sp", name)) not in _LOADED:
        import sentencepiece

        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_file=path(name))
    return _LOADED[key]


def once(key, make):
    """One object a Python worker, so that memo tables outlive a task."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]
