import hashlib
import io
import wave
import zlib

import numpy as np

from speechtables.llm import audio
from speechtables.llm.common import stored
from tests.llm.helpers import documents, odd_texts


def payload(text):
    data = (text or "").encode()
    return data + b"\0" * (64 if not data else -len(data) % 64)


def test_round_trip_and_features(spark):
    texts = odd_texts() + odd_texts()
    media = stored(audio.media_table(documents(spark, texts, "media")), "media-test")
    rows = {r["doc_id"]: r for r in audio.audio_features(media, "doc_id", "n_bytes").collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, data = rows[i], payload(text)
        with wave.open(io.BytesIO(files[i])) as opened:
            assert (opened.getsampwidth(), opened.getnchannels(), opened.getframerate()) == (1, 1, 16000)
            assert opened.readframes(len(data) + 1) == data
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
        table = audio.read_tensors(bytes(r["tensors"]))
        tensors = table["log_mel"].combine_chunks().to_numpy_ndarray()
        assert tensors.shape == (r["windows"], audio.WINDOW, audio.BANDS)
        assert table["start_ms"].to_pylist() == [640 * w for w in range(r["windows"])]
        assert table["end_ms"].to_pylist()[-1] == 10 * r["frames"]
        twin = rows[(i + len(texts) // 2) % len(texts)]
        assert r["tensors"] == twin["tensors"]


def test_a_tone_stays_in_its_band():
    at = np.arange(16000) / 16000
    mel_of = lambda hz: audio.log_mel(audio.resampled((128 + 100 * np.sin(2 * np.pi * hz * at)).astype(np.uint8)))
    low, high = mel_of(400), mel_of(3000)
    assert len(low) == 1 + (10000 - 256) // 100
    assert low[20].argmax() < high[20].argmax()
    assert mel_of(7600)[20].max() < low[20].max() - 150  # above the new limit: filtered


def test_hysteresis_against_a_loop():
    draw = np.random.default_rng(3)
    energy = np.repeat(draw.normal(size=60), 5) + draw.normal(size=300) / 3
    on, off = energy.mean() + 0.5 * energy.std(), energy.mean()
    loud, spans, begin = False, [], 0
    for i, e in enumerate([*energy, -np.inf]):
        if not loud and e >= on:
            loud, begin = True, i
        elif loud and e < off:
            loud = False
            if i - begin >= 3:
                spans.append((begin, i))
    assert audio.loud_spans(energy) == spans


def test_no_rows_and_no_media(spark):
    assert audio.audio_features(audio.media_table(documents(spark, []))).count() == 0
    broken = spark.createDataFrame([(1, b"noise"), (2, None)], "doc_id bigint, media binary")
    assert [r["frames"] for r in audio.audio_features(broken).collect()] == [None, None]
