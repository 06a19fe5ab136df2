"""Settings for the three preparation stages and the inference selection steps.

Everything under "Fixed values" must stay exactly as written: prompts, special
tokens and patterns are what the trained models saw, so changing one changes
the samples.  Token strings marked [ext] come from the public chat template of
the language model family the stages were built for, not from this package.
"""

from __future__ import annotations

from dataclasses import dataclass


# ---------------------------------------------------------------------------
# Fixed values (must match the training scripts' behaviour exactly)
# ---------------------------------------------------------------------------

IMAGE_TAG = "<image>"
IMAGE_PAD = "<|image_pad|>"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ROLE_ASSISTANT = "assistant"
EOS_TOKEN = "<|im_end|>"  # [ext] end-of-turn token used as EOS by the instruct model
PAD_TOKEN = "<|endoftext|>"  # [ext] pad token of the same tokenizer
LABEL_IGNORE = -100  # stage-3 label padding value

IMAGE_PAD_NUM = 243  # pads per image, stages 1-3 and the test script
IMAGE_PAD_NUM_DEMO = 49  # pads per image in the web demo

SYSTEM_STAGE1 = "You are a helpful assistant."
SYSTEM_STAGE2 = "你是一个几何专家，能够详细解答几何问题。"
SYSTEM_STAGE3 = "你是一个数学推理验证专家，能够辨别推理步骤中的错误。"

FALLBACK_STAGE1_USER = "图片内容是什么\n<image>"
FALLBACK_STAGE1_ANSWER = "图片内容为空"
FALLBACK_STAGE2_USER = "这个几何图像无法加载，请提供一个一般性解答\n<image>"
FALLBACK_STAGE2_ANSWER = (
    "抱歉，我无法查看这个几何图像。请提供几何问题的详细描述，包括已知条件和需要求解的内容，我将尽力帮助您解答。"
)
FALLBACK_STAGE3_TEXT = "图像无法加载。"
FALLBACK_IMAGE_SIZE = 224  # white square used when an image cannot be read

HUMAN_ROLE = "human"
ASSISTANT_ROLES = ("gpt", "assistant")

# Image path layout of the stage-3 image store.
PATH_PREFIX_DATASET = "MathV-360k/"
PATH_PREFIX_IMAGES = "data_images/"
PATH_IMAGES_DIR = "data_images"

# Reasoning step: header, lazily everything up to the marker letter, then an
# optional verdict.  Python's re is Unicode-aware and DOTALL is on.
STEP_PATTERN_BODY = r"(Step \d+:|步骤 ?\d+[：:]).*?и\s*(<pos>|<neg>)?"
STEP_POS = "<pos>"
STEP_NEG = "<neg>"

# Regex tokenizer standing in for the pretrained sub-word tokenizer:
# special tokens whole, words with one optional leading space, single
# punctuation characters, single whitespace characters.  Lossless.
TOKEN_PATTERN = r"<\|[a-z_]+\|>| ?[\p{L}\p{N}]+|[^\p{L}\p{N}\s]|\s"

# Special tokens get the first ids, in this order; every other token is
# numbered after them by falling frequency, then by its UTF-8 bytes.
SPECIAL_TOKENS = (PAD_TOKEN, IM_START, IM_END, IMAGE_PAD)

# ---------------------------------------------------------------------------
# Spark / SQL dialect forms of the patterns
# ---------------------------------------------------------------------------

# Java regex: (?s) DOTALL, (?U) makes \d and \s Unicode like Python's re.
STEP_PATTERN_JAVA = "(?sU)" + STEP_PATTERN_BODY
# RE2 (DuckDB): only (?s); RE2's U flag means "ungreedy".
STEP_PATTERN_RE2 = "(?s)" + STEP_PATTERN_BODY


@dataclass(frozen=True)
class StageConfig:
    """Per-stage training-data settings (batching, schedule, checkpoints)."""

    name: str
    batch_size: int
    grad_accum: int
    epochs: int
    learning_rate: float
    save_steps: int
    save_total_limit: int
    logging_steps: int
    loader_workers: int
    eval_steps: int | None = None
    val_fraction: float = 0.0
    seed: int = 42
    image_pad_num: int = IMAGE_PAD_NUM


STAGE1 = StageConfig("pretrain", 16, 8, 5, 5e-4, 5000, 1, 500, 8)
STAGE2 = StageConfig("sft", 4, 8, 3, 1e-5, 2000, 2, 100, 4)
STAGE3 = StageConfig("verifier", 4, 8, 2, 3e-5, 2000, 2, 100, 8, eval_steps=2000, val_fraction=0.05)

MAX_NEW_TOKENS = 100  # decode limit; the loop yields at most MAX_NEW_TOKENS - 1
