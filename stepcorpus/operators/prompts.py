"""Message selection, image paths and prompt rendering.

Every function maps a DataFrame to a DataFrame (use with ``df.transform``)
or returns a Column; all are narrow (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus import settings as S
from stepcorpus.functions import text as T


def positional_pair(df: DataFrame, conversations: str = "conversations",
                    question: str = "question", answer: str = "answer") -> DataFrame:
    """Element 0 is the question and element 1 the answer, whatever
    their roles; later turns are ignored.  Fewer than two turns, or a null
    text, sets ``pair_error``."""
    conv = F.col(conversations)
    q = F.get(conv, 0)["value"]
    a = F.get(conv, 1)["value"]
    err = (F.when(conv.isNull() | (F.size(conv) < 2), F.lit("too_few_turns"))
           .when(q.isNull() | a.isNull(), F.lit("null_text")))
    return df.withColumns({question: q, answer: a, "pair_error": err})


def role_pair(df: DataFrame, conversations: str = "conversations",
              question: str = "question", answer: str = "answer") -> DataFrame:
    """The first ``human`` turn and the first ``gpt``/``assistant`` turn,
    in any order.  A missing role or a null text sets ``pair_error``."""
    conv = F.col(conversations)
    human = F.get(F.filter(conv, lambda m: m["from"] == F.lit(S.HUMAN_ROLE)), 0)
    bot = F.get(F.filter(conv, lambda m: m["from"].isin(*S.ASSISTANT_ROLES)), 0)
    err = (F.when(human.isNull(), F.lit("no_human_turn"))
           .when(bot.isNull(), F.lit("no_assistant_turn"))
           .when(human["value"].isNull() | bot["value"].isNull(), F.lit("null_text")))
    return df.withColumns({question: human["value"], answer: bot["value"], "pair_error": err})


def resolve_image_path(url: Column, base: str) -> Column:
    """Map a record's image URL into the image store under ``base``."""
    rest = F.substring(url, len(S.PATH_PREFIX_DATASET) + 1, 1 << 30)
    return (F.when(url.startswith(S.PATH_PREFIX_DATASET),
                   T.join_path_lit(base, S.PATH_IMAGES_DIR, rest))
            .when(~url.startswith(S.PATH_PREFIX_IMAGES),
                  T.join_path_lit(base, S.PATH_IMAGES_DIR, url))
            .otherwise(T.join_path_lit(base, url)))


def join_path(root: Column | str, rel: Column | str) -> Column:
    """``os.path.join(root, rel)``."""
    return T.join_path(root, rel)


def render_chat(messages, add_generation_prompt: bool) -> Column:
    """P5: ChatML rendering of (role, content) pairs."""
    return T.render_chat(messages, add_generation_prompt)


def expand_image_tag(text: Column, n: int = S.IMAGE_PAD_NUM) -> Column:
    """Every ``<image>`` becomes n image-pad tokens."""
    return T.expand_image_tag(text, n)


def append_eos(text: Column) -> Column:
    """Answer text followed by the EOS token."""
    return T.append_eos(text)


def instruction_text(instruction: Column, present: Column | None = None) -> Column:
    """The user text of a stage-3 prompt: an explicit null prints as ``None``
    (it goes through an f-string); a missing key is the empty string."""
    if present is None:
        return F.coalesce(instruction, F.lit("None"))
    return F.when(instruction.isNotNull(), instruction).when(present, F.lit("None")).otherwise(F.lit(""))


def render_instruction(instruction: Column, use_template: bool = True,
                       present: Column | None = None) -> Column:
    """The stage-3 prompt; with no chat template the raw text is used,
    and an explicit null stays null (a tokenizer can't take it, so the record
    needs the stage-3 default sample)."""
    if not use_template:
        return instruction if present is None else F.when(~present, F.lit("")).otherwise(instruction)
    user = instruction_text(instruction, present)
    return T.render_chat([("system", S.SYSTEM_STAGE3), ("user", user)], add_generation_prompt=True)


def stage3_prompt_prefix() -> str:
    """Rendered text in front of the instruction in the stage-3 prompt."""
    return (f"{S.IM_START}system\n{S.SYSTEM_STAGE3}{S.IM_END}\n"
            f"{S.IM_START}user\n")


def check_pad_count(ids: Column, pad: Column, expected: Column) -> tuple[Column, Column]:
    """(number of image-pad positions, whether it equals the feature rows)."""
    n = F.size(F.filter(ids, lambda t: t == pad))
    return n, n == expected
