"""Quoting for expressions written as SQL text."""


def sql_text(text: str) -> str:
    """A Spark SQL string literal; ``${`` is written so that no variable is put in its place."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"
