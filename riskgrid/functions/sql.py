"""Numbers as SQL text."""


def double(x: float) -> str:
    """A double literal that reads back as the same number."""
    return f"{float(x)!r}D"


def long(x: int) -> str:
    return f"{int(x)}L"
