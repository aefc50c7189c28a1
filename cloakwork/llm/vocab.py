"""Places of the public vocabulary files; every operator also takes a path as a parameter."""


def _path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def BYTE_BPE() -> str:  # noqa: N802
    return _path("byte_bpe_50k.json")


def PIECES() -> str:  # noqa: N802
    return _path("piece_bpe_32k.model")
