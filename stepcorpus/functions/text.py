"""Column expressions for paths, chat prompts, image tags and tokens.

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation and need no Python at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepcorpus import settings as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _join2(left: Column, part: Column) -> Column:
    return (F.when(part.startswith("/"), part)
            .when((left == F.lit("")) | left.endswith("/"), F.concat(left, part))
            .otherwise(F.concat(left, F.lit("/"), part)))


def join_path(root: Column | str, *parts: Column | str) -> Column:
    """``os.path.join`` on columns: an absolute part replaces what came before,
    an empty or slash-terminated prefix takes the part without a new slash.
    Strings name columns."""
    out = _col(root)
    for part in parts:
        out = _join2(out, _col(part))
    return out


def join_path_lit(root: str, *parts: Column | str) -> Column:
    """``join_path`` whose first part is a literal folder."""
    out = F.lit(root)
    for part in parts:
        out = _join2(out, F.lit(part) if isinstance(part, str) else part)
    return out


def chat_turn(role: str | Column, content: Column) -> Column:
    """One ChatML message: ``<|im_start|>{role}\\n{content}<|im_end|>\\n``."""
    r = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(S.IM_START), r, F.lit("\n"), content, F.lit(S.IM_END), F.lit("\n"))


def render_chat(messages: Sequence[tuple[str | Column, Column | str]],
                add_generation_prompt: bool) -> Column:
    """Render (role, content) pairs with the ChatML template; a null content
    makes the whole prompt null, as the template raises on it."""
    parts = [chat_turn(role, F.lit(c) if isinstance(c, str) else c) for role, c in messages]
    if add_generation_prompt:
        parts.append(F.lit(f"{S.IM_START}{S.ROLE_ASSISTANT}\n"))
    return F.concat(*parts)


def expand_image_tag(text: Column, n: int = S.IMAGE_PAD_NUM) -> Column:
    """Replace every ``<image>`` by n image-pad tokens."""
    return F.replace(text, F.lit(S.IMAGE_TAG), F.lit(S.IMAGE_PAD * n))


def append_eos(text: Column) -> Column:
    return F.concat(text, F.lit(S.EOS_TOKEN))


def tokenize(text: Column) -> Column:
    """Split text into tokens (array<string>); lossless, specials kept whole."""
    return F.regexp_extract_all(text, F.lit(S.TOKEN_PATTERN), 0)


def token_count(text: Column) -> Column:
    return F.size(tokenize(text))


def index_range(n: Column) -> Column:
    """``[0, n)`` as an array; empty when n <= 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
