"""Where the vocabulary files of public tokenizers are: never in this repository."""

from __future__ import annotations

import os


def model_file(name: str, folder: str | None = None) -> bytes:
    """The content of a vocabulary file; folder: default the installed package of
    public tokenizers. It is read on the driver and travels with the tasks."""
    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(name))
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def word_pattern() -> str:
    """The pattern by which the byte-level vocabularies cut texts into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN
