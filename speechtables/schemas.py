"""Schemas of the tables and documents the library reads and writes."""

from __future__ import annotations

WORD = "struct<word: string, start: double, end: double, probability: double>"

UTTERANCE = f"struct<text: string, start: double, end: double, speaker: int, words: array<{WORD}>>"

SEGMENTS = (
    "recording_id bigint, seq bigint, channel int, start double, end double, text string, tokens array<int>, "
    f"avg_logprob double, compression_ratio double, no_speech_prob double, temperature double, words array<{WORD}>"
)

TURNS = "recording_id bigint, seq bigint, start double, end double, speaker int"

FRAMES = "recording_id bigint, frame bigint, prob double"

EMBEDDINGS = "recording_id bigint, scale int, seg_idx bigint, offset double, duration double, vec array<float>"

PROCESS_TIMES = "struct<total: double, transcription: double, diarization: double, post_processing: double>"

OPTIONS = (
    "offset_start double, offset_end double, num_speakers int, diarization boolean, multi_channel boolean, "
    "source_lang string, timestamps string, vocab array<string>, word_timestamps boolean, internal_vad boolean, "
    "repetition_penalty double, compression_ratio_threshold double, log_prob_threshold double, "
    "no_speech_threshold double, condition_on_previous_text boolean, job_name string, task_token string"
)

JOBS = f"{OPTIONS}, batch_size int, num_beams int"

RESPONSE = f"utterances array<{UTTERANCE}>, audio_duration double, {OPTIONS}, process_times {PROCESS_TIMES}"

CHUNK = "source_lang string, chunk_id bigint, ts timestamp, audio binary"

STATUS_EVENT = "event_type string, event_id string, payload_retention_period int, payload string"

ERRORS = "job string, source string, message string"
