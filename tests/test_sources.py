"""WAV files, manifests and artifacts."""

import io
import json
import wave

import numpy as np
import pytest

from turnloom.sources import audio, sinks


def raw_wav(raw, width, channels, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def test_decode_widths():
    assert audio.decode(raw_wav(bytes([0, 128, 255]), 1, 1, 8000))[0][:, 0].tolist() == [-1, 0, 127 / 128]
    for width in (2, 3, 4):
        top = 2 ** (8 * width - 1)
        raw = b"".join(v.to_bytes(width, "little", signed=True) for v in (-top, 0, top // 2, 1))
        x, rate = audio.decode(raw_wav(raw, width, 2, 44100))
        assert rate == 44100 and x.shape == (2, 2) and np.allclose(x.ravel(), [-1, 0, 0.5, 1 / top], atol=1e-9)
    with pytest.raises(ValueError):
        audio.decode(raw_wav(bytes(400), 2, 1, 8000)[:-7])
    x = np.linspace(-1.5, 1.5, 50)
    assert np.abs(audio.decode(audio.encode(x, 16000))[0][:, 0] - np.clip(x, -1, 1)).max() < 1e-4


def test_resample_keeps_tones():
    for rate in (8000, 22050, 44100, 48000):
        x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
        y = audio.resample(x, rate)
        assert len(y) == 16000 and np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000))[200:-200].max() < 0.01
    assert audio.resample(np.zeros(0), 8000).size == 0


def test_read_wav_and_durations(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.encode(np.zeros((8000 * 25, 2)), 8000))
    (tmp_path / "b.wav").write_bytes(audio.encode(np.full(100, 0.5), 16000))
    rows = sorted((r.path[-5:], r.start_sample, len(r.samples), r.duration_sec) for r in audio.read_wav(spark, str(tmp_path)).collect())
    assert rows == [("a.wav", 0, 160000, 25.0), ("a.wav", 160000, 160000, 25.0), ("a.wav", 320000, 80000, 25.0), ("b.wav", 0, 100, 100 / 16000)]
    assert sorted(r.duration_sec for r in audio.durations(spark, str(tmp_path)).collect()) == [100 / 16000, 25.0]


def test_manifest_and_gate(spark, tmp_path):
    at = tmp_path / "m.json"
    at.write_text(json.dumps([{"audio_path": "x.wav", "segments": [{"start": 0, "end": 1.5, "speaker": "A", "text": "hi"}]}, {"audio_name": "n", "audio_path": "y.wav"}]))
    rows = audio.read_manifest(spark, str(at)).collect()
    assert [r.audio_path for r in rows] == ["x.wav", "y.wav"] and rows[0].segments[0].end == 1.5 and rows[1].segments is None
    at.write_text(json.dumps([{"audio_name": "n"}]))
    with pytest.raises(Exception, match="audio_path"):
        audio.read_manifest(spark, str(at)).collect()

    schema = "rec long, seq long, tick double, start double, end double, speaker string, text string"
    good, early, twice = (1, 0, 4.0, 0.0, 2.0, "S01", "a"), (2, 0, 1.0, 0.0, 2.0, "S01", "a"), (3, 0, 4.0, 0.0, 2.0, "S01", "a")
    passed = sinks.write_run(spark.createDataFrame([good, early, twice, (3, 1, 6.0, 0.0, 2.0, "S02", "a"), (4, 0, 3.0, 0.0, 1.0, None, "b")], schema), str(tmp_path / "run"))
    assert {r.rec: r.passed for r in passed.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [tuple(r) for r in sinks.read_committed(spark, str(tmp_path / "run")).collect()] == [(1, 0.0, 2.0, "S01", "a")]
