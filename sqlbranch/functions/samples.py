"""Functions that CREATE FUNCTION can load, as examples."""


def one_word_lines(text: str | None) -> str | None:
    return None if text is None else "\n".join(text.split(" "))
