"""Fixed values that results depend on."""

SAMPLE_RATE = 24_000
FRAME_RATE = 12.5
FRAME_SIZE = 1_920  # samples of one step: SAMPLE_RATE / FRAME_RATE
CODEBOOKS, ACTIVE_LEVELS, BINS = 32, 8, 2_048
TEXT_CARD, CONTEXT_STEPS = 32_000, 3_000

#: Special token ids.
ZERO_TOKEN, UNGENERATED, TEXT_START, TEXT_PAD, END_OF_TEXT_PAD = -1, -2, 32_000, 3, 0

#: Delay in steps of each of the 17 channels: text, 8 of the agent, 8 of the user.
DELAYS = [0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1]

#: Codes of a silent frame and of a frame of a 440 Hz tone.
SILENCE = [948, 243, 1178, 546, 1736, 1030, 1978, 2008]
SINE = [430, 1268, 381, 1611, 1095, 1495, 56, 472]

#: Message kinds by their first byte, and control actions by their number.
KINDS = ["handshake", "audio", "text", "control", "metadata", "error", "ping"]
ACTIONS = ["start", "endTurn", "pause", "restart"]

#: Sampling defaults.
TEXT_TEMPERATURE, TEXT_TOP_K, AUDIO_TEMPERATURE, AUDIO_TOP_K = 0.7, 25, 0.8, 250

#: The parameters of a session's url in the client's order, and the defaults as the client writes them.
SESSION_PARAMS = [
    "text_temperature", "text_topk", "audio_temperature", "audio_topk", "pad_mult", "text_seed", "audio_seed",
    "repetition_penalty_context", "repetition_penalty", "text_prompt", "voice_prompt",
]
SESSION_DEFAULTS = {
    "text_temperature": "0.7", "text_topk": "25", "audio_temperature": "0.8", "audio_topk": "250", "pad_mult": "0",
    "repetition_penalty_context": "64", "repetition_penalty": "1",
}
