"""Schemas of the tables that the engine's operators exchange."""

MESSAGE = "session_id string, ts timestamp, kind tinyint, payload binary"
FRAME = "session_id string, stream string, frame_idx bigint, pcm array<float>"
CODE = "session_id string, t bigint, level int, code bigint"
CODEBOOK = "level int, code bigint, centroid array<double>"
TOKEN = "session_id string, step bigint, k int, token bigint, provided boolean"
CHANNEL = "k int, stream string, delay int"
LOGIT = "session_id string, step bigint, k int, code bigint, logit double"
PROMPT = "prompt_id string, phase int, step bigint, text_token bigint, agent array<bigint>, user array<bigint>"

#: Records that operators return as structs.
LM_OUTPUT = "logits array<double>, mask boolean, text_logits array<double>, text_mask boolean"
QUANTIZED = "decoded array<double>, codes array<bigint>, bandwidth double, penalty double"
AUDIO_STATS = "total double, actual double, missed double, delay double, min_delay double, max_delay double"
