"""Text rules of prompts, transcripts, labels and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

TAG = "<system>"


def strip(c: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def wrap_system(c: Column) -> Column:
    """Trim, and put the tag at both ends unless it is there. Both ends have the opening form."""
    t = strip(c)
    return F.when(t.startswith(TAG) & t.endswith(TAG), t).otherwise(F.concat(F.lit(TAG + " "), t, F.lit(" " + TAG)))


def piece_text(piece: Column) -> Column:
    return F.replace(piece, F.lit("▁"), F.lit(" "))


def pad_name(token: Column, piece: Column) -> Column:
    """Offline transcripts name the padding tokens; other tokens show their piece."""
    return F.when(token == 0, "EPAD").when(token == 3, "PAD").otherwise(piece_text(piece))


def minutes_seconds(seconds: Column) -> Column:
    """m:ss.cc"""
    whole = F.floor(seconds)
    cents = F.floor(100 * (seconds - whole))
    return F.concat(
        F.floor(seconds / 60).cast("string"),
        F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad(cents.cast("string"), 2, "0"),
    )


def voice_label(name: Column) -> Column:
    out = F.regexp_replace(name, r"\.pt$", "")
    return F.replace(F.replace(out, F.lit("NAT"), F.lit("NATURAL_")), F.lit("VAR"), F.lit("VARIETY_"))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_tensor_file(path: Column) -> Column:
    return path.rlike(r"\.(safetensors|sft|sfts)$")


def link(base: Column, **params: Column) -> Column:
    """A url with all parameters, encoded."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    return F.concat(base, F.lit("?"), F.concat_ws("&", *parts))


def session_link(base: Column, text_prompt: Column, voice_prompt: Column, text_seed: Column, audio_seed: Column, **changed: Column) -> Column:
    """The url of a session: all 11 mandatory parameters in the client's order, the prompt whole; `changed` replaces defaults."""
    params = {k: F.lit(v) for k, v in C.SESSION_DEFAULTS.items()} | {"text_seed": text_seed, "audio_seed": audio_seed}
    params |= {"text_prompt": F.coalesce(text_prompt, F.lit("")), "voice_prompt": voice_prompt}
    if unknown := set(changed) - set(C.SESSION_DEFAULTS):
        raise ValueError(f"no parameters of a session: {sorted(unknown)}")
    return link(base, **{k: (params | changed)[k] for k in C.SESSION_PARAMS})


def extension(mime: Column) -> Column:
    return F.when(mime.startswith("audio/mp4"), "mp4").when(mime.startswith("audio/ogg"), "ogg").when(
        mime.startswith("audio/wav"), "wav"
    ).otherwise("webm")


def as_ms(samples: Column, rate: int = 24_000) -> Column:
    return F.round(samples * 1000 / rate, 1)


def as_samples(ms: Column, rate: int = 24_000) -> Column:
    return F.floor(ms * rate / 1000 + 0.5).cast("bigint")
