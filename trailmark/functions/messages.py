"""Chat messages, statuses and recorder input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample statuses.
STATUSES = (
    "running", "completed", "agent context limit", "agent validation failed", "agent invalid action",
    "task limit reached", "unknown", "task error",
)
# Report label of each status that counts for one.
VALIDATION_LABELS = {
    "completed": "Completed",
    "agent context limit": "Context Limit Exceeded",
    "agent validation failed": "Invalid Format",
    "agent invalid action": "Invalid Action",
    "unknown": "Task Limit Exceeded",
    "task error": "Task Limit Exceeded",
    "task limit reached": "Task Limit Exceeded",
}
# Keyboard key of each action flag.
KEY_FLAGS = {
    "key.keyboard.escape": "ESC",
    "key.keyboard.s": "back",
    "key.keyboard.q": "drop",
    "key.keyboard.w": "forward",
    "key.keyboard.1": "hotbar.1",
    "key.keyboard.2": "hotbar.2",
    "key.keyboard.3": "hotbar.3",
    "key.keyboard.4": "hotbar.4",
    "key.keyboard.5": "hotbar.5",
    "key.keyboard.6": "hotbar.6",
    "key.keyboard.7": "hotbar.7",
    "key.keyboard.8": "hotbar.8",
    "key.keyboard.9": "hotbar.9",
    "key.keyboard.e": "inventory",
    "key.keyboard.space": "jump",
    "key.keyboard.a": "left",
    "key.keyboard.d": "right",
    "key.keyboard.left.shift": "sneak",
    "key.keyboard.left.control": "sprint",
    "key.keyboard.f": "swapHands",
}
# Fixed value: degrees per unit of mouse movement.
CAMERA_SCALE = 360.0 / 2400.0


def normalise_status(status: Column) -> Column:
    """Both spellings of a status as the lower-case one; null for an unknown word."""
    text = F.replace(F.lower(F.trim(status)), F.lit("_"), F.lit(" "))
    return F.when(text.isin(*STATUSES), text)


def validation_label(status: Column) -> Column:
    label = F.lit(None).cast("string")
    text = normalise_status(status)
    for name, value in VALIDATION_LABELS.items():
        label = F.when(text == name, value).otherwise(label)
    return label


def rewrite_image_url(content: Column) -> Column:
    """Image entries of a message with the path form of their URL."""
    return F.transform(
        content,
        lambda part: F.when(
            part["type"] == "image_url",
            part.withField("image_url", F.regexp_replace(part["image_url"], r"^file://", "")),
        ).otherwise(part),
    )


def input_flags(keys: Column) -> list[Column]:
    """One 0/1 column per keyboard flag."""
    return [
        F.coalesce(F.array_contains(keys, key), F.lit(False)).cast("int").alias(flag)
        for key, flag in KEY_FLAGS.items()
    ]


def camera(delta: Column) -> Column:
    return delta * F.lit(CAMERA_SCALE)


def is_null_input(keys: Column, dx: Column, dy: Column, buttons: Column) -> Column:
    """No known key, no mouse movement and no known button."""
    known = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in KEY_FLAGS]))
    pressed = F.arrays_overlap(buttons, F.array(F.lit(0), F.lit(1), F.lit(2)))
    return ~(F.coalesce(known, F.lit(False)) | (dx != 0) | (dy != 0) | F.coalesce(pressed, F.lit(False)))


def episode_name(
    base: Column, agent1: Column, agent2: Column, max_frames: Column, frames: Column, seed: Column, reason: Column
) -> Column:
    """Folder name that carries the settings and the outcome of a recorded episode."""
    lowered = F.lower(reason)
    label = F.concat(F.upper(F.substring(lowered, 1, 1)), F.substring(lowered, 2, 2147483647))
    return F.concat(
        base, F.lit("_models["), agent1, F.lit(","), agent2, F.lit("]_mxFrm"), max_frames.cast("string"),
        F.lit("_nmFrm"), frames.cast("string"), F.lit("_seed"), seed.cast("string"), F.lit("_term"), label,
    )


def parse_episode_name(path: Column) -> Column:
    """Struct of frame count, end flag and end reason taken from an episode path."""
    name = F.substring_index(path, "/", -1)
    ended = name.contains("term")
    reason = F.substring_index(F.get(F.split(name, "term"), F.lit(1)), "_", 1)
    frames = F.regexp_extract(name, r"_nmFrm(\d+)", 1).try_cast("int")
    return F.struct(
        frames.alias("num_frames"), ended.alias("is_term"),
        F.when(ended, reason).otherwise("Incomplete").alias("term_reason"),
    )


def ordered_quantity(label: Column) -> Column:
    """Number after the seven-letter word in front of it; 0 when there is none."""
    return F.coalesce(F.trim(F.substring(label, 8, 2147483647)).try_cast("int"), F.lit(0))
