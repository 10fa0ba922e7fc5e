import hashlib
import io
import wave
import zlib

import numpy as np

from gleanloom.llm import audio


def test_wav_is_read_by_another_reader():
    data, size = audio.padded("héllo" * 100)
    with wave.open(io.BytesIO(audio.wav(data))) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 1, audio.RATE)
        assert f.readframes(f.getnframes()) == data
    assert audio.wav_samples(audio.wav(data)) == (data, audio.RATE) and size == 600


def test_polyphase_equals_filtering_the_stuffed_signal():
    x = np.random.default_rng(1).normal(size=500)
    branches = audio.lowpass()
    h = np.empty(branches.size)
    for k in range(audio.UP):
        h[k :: audio.UP] = branches[k][::-1]
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    want = np.convolve(stuffed, h)[: len(stuffed)][:: audio.DOWN]
    got = audio.resample(x, 0, len(want), branches)
    assert np.allclose(got, want)
    assert np.allclose(audio.resample(x, 100, 50, branches), want[100:150])


def test_blocks_do_not_show_and_a_tone_lands_in_its_band(monkeypatch):
    t = np.arange(3 * audio.RATE) / audio.RATE
    data = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    whole, energy = audio.Features().log_mels(data)
    monkeypatch.setattr(audio, "FRAMES_A_BLOCK", 17)
    parts, _ = audio.Features().log_mels(data)
    assert np.allclose(whole, parts, atol=1e-4)
    centre = np.argmax(audio.mel_filters()[np.argmin(abs(np.fft.rfftfreq(audio.FFT, 1 / 16000) - 1000))])
    assert np.argmax(whole[20]) == centre


def test_hysteresis():
    energy = np.zeros(100)
    energy[10:20], energy[20:25], energy[27:30], energy[60:61] = 5, 2, 4, 9
    step = audio.HOP / 16000
    assert np.allclose(audio.segments(energy), [(10 * step, 30 * step)])
    assert audio.segments(np.zeros(50)) == []


def test_rows(spark):
    texts = ["", None, "a", "x" * 192, "y" * 193, "word " * 60_000, "a"]
    docs = spark.createDataFrame([(k if k != 3 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = audio.store_media(docs)
    rows = audio.audio_features(stored)
    got = {r["doc_id"]: r for r in audio.digests(stored).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        row, payload = got[k if k != 3 else None], audio.padded(text)[0]
        assert row["payload_bytes"] == len(payload) and len(payload) % 192 == 0 and len(payload)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-16:])
        assert row["media_sha256"] == hashlib.sha256(audio.wav(payload)).hexdigest()
    assert got[0]["feature"] == got[1]["feature"] and got[2]["feature"] == got[6]["feature"] != got[0]["feature"]
    first = rows.where("doc_id = 5").first()
    table = audio.read_tensors(bytes(first["tensors"]))
    assert table.schema.field("log_mel").type == audio.TENSOR
    assert sum(table.column("frames").to_pylist()) == first["frames"]
    assert audio.digests(audio.store_media(docs.limit(0))).collect() == []
