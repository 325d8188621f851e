"""Sample arrays: tones with envelopes, mixes and sweeps, as rows (clip, i, v)."""

from __future__ import annotations

import math

from ..plans.registry import query

RATE = 22_050


def _range(d, n: int) -> str:
    return f"SELECT id AS i FROM range({n})" if d.name == "spark" else f"SELECT range AS i FROM range({n})"


def tone(d, freq: float, seconds: float, gain: float = 0.5, slide: float = 0.0, attack: float = 0.01, release: float = 0.05, square: bool = False) -> str:
    """Rows (i, v): phase in closed form, linear attack times linear release."""
    n = int(RATE * seconds)
    phase = f"{2 * math.pi * freq / RATE!r}e0 * ((i + 1) + {slide}e0 * i * (i + 1) / {2 * n}e0)"
    wave = f"CASE WHEN sin({phase}) >= 0 THEN 1e0 ELSE -1e0 END" if square else f"sin({phase})"
    env = f"least(1e0, i / {RATE * attack}e0) * least(1e0, ({n} - i) / {RATE * release}e0)"
    return f"SELECT i, {gain}e0 * {env} * {wave} AS v FROM ({_range(d, n)}) r"


def _envelope(n: int, attack: float, release: float) -> str:
    """Linear attack times linear release."""
    return f"least(1e0, i / {RATE * attack}e0) * CASE WHEN ({n} - i) / {RATE}e0 > {release}e0 THEN 1e0 ELSE ({n} - i) / {RATE * release}e0 END"


def noise(d, seconds: float, gain: float = 0.5, lowpass: float = 0.3, release: float = 0.25, seed: int = 1, taps: int = 64) -> str:
    """Rows (i, v): noise of a multiplicative generator through a one-pole low-pass, whose
    weights fall below 1e-9 after ``taps`` samples."""
    n = int(RATE * seconds)
    # An integer hash of the index in place of a random source: the same on every run and engine.
    step = lambda x: f"(({x}) * 48271 % 2147483647)"
    drawn = f"({step(step(f'(greatest(i - k, 0) * 7919 + {seed * 104_729 + 1})'))} / 1073741823.5e0 - 1e0)"
    heard = f"CASE WHEN k <= i THEN {lowpass}e0 * pow({1 - lowpass}e0, k) * {drawn} ELSE 0e0 END"
    return f"SELECT i, {gain}e0 * {d.total(d.map(d.seq('0', str(taps - 1)), 'k', heard))} * {_envelope(n, 0.001, release)} AS v FROM ({_range(d, n)}) r"


def joined(parts: list[tuple[str, float]]) -> str:
    """Clips ``(rows, seconds)`` one after another."""
    at, out = 0, []
    for k, (rows, seconds) in enumerate(parts):
        out.append(f"SELECT i + {at} AS i, v FROM ({rows}) p{k}")
        at += int(RATE * seconds)
    return " UNION ALL ".join(out)


def mixed(layers: list[str], clamp: bool = False) -> str:
    """The sum of clips, shorter ones padded with silence."""
    both = " UNION ALL ".join(f"SELECT i, v FROM ({rows}) l{k}" for k, rows in enumerate(layers))
    return f"SELECT i, {'greatest(-1e0, least(1e0, sum(v)))' if clamp else 'sum(v)'} AS v FROM ({both}) m GROUP BY i"


def sound(d, freq, seconds, square=False, gain=0.6, slide=0.0, attack=0.005, release=0.12) -> str:
    return tone(d, freq, seconds, gain, slide, attack, release, square)


def engine(d, seconds: float = 0.9) -> str:
    """A rising square with a wobble: its phase is the running sum of the frequency."""
    n = int(RATE * seconds)
    pitch = f"(60e0 + 220e0 * pow(i / {n}e0, 1.6e0)) * (1e0 + 0.03e0 * sin({2 * math.pi * 9 / RATE!r}e0 * i))"
    return f"SELECT i, 0.4e0 * CASE WHEN sin(phase) >= 0 THEN 1e0 ELSE -1e0 END * {_envelope(n, 0.05, 0.2)} AS v FROM (SELECT i, round(sum({2 * math.pi / RATE!r}e0 * {pitch}) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS phase FROM ({_range(d, n)}) r) x"


#: The melody's notes by step, in half tones of a five-tone scale (a fixed score in place of a seeded choice).
SCORE = (0, 4, 7, 9, 12, 7, 4, 2, 0, 2, 4, 7, 9, 7, 4, 0)


def music(d, seconds: float = 10.0, bpm: int = 112, root: float = 220.0) -> str:
    """A loop: bass on every second beat, a soft hat on each, the melody off the beat.

    Kinds of sounds are made once; the schedule (one row a sound) is joined to their samples."""
    beat, n = 60.0 / bpm, int(RATE * seconds)
    kinds, plan_, step, at = {}, [], 0, 0.0
    while at < seconds:
        if step % 2 == 0:
            plan_.append((int(at * RATE), "bass"))
        plan_.append((int(at * RATE), "hat"))
        if step % 4 != 2:
            note = SCORE[step % len(SCORE)]
            kinds[f"n{note}"] = sound(d, root * 2 ** (note / 12), beat * 0.6, gain=0.22, release=0.1)
            plan_.append((int((at + beat * 0.5) * RATE), f"n{note}"))
        at, step = at + beat, step + 1
    kinds |= {"bass": sound(d, root / 2, beat * 0.9, gain=0.28, release=0.2), "hat": sound(d, 6000, 0.03, True, 0.05, release=0.02)}
    sounds = " UNION ALL ".join(f"SELECT '{name}' AS kind, i, v FROM ({rows}) k{j}" for j, (name, rows) in enumerate(sorted(kinds.items())))
    rows = ", ".join(f"({start}, '{kind}')" for start, kind in plan_)
    placed = f"SELECT e.start_ + s.i AS i, s.v FROM (VALUES {rows}) AS e(start_, kind) JOIN ({sounds}) s ON s.kind = e.kind WHERE e.start_ + s.i < {n}"
    return f"SELECT r.i, greatest(-1e0, least(1e0, coalesce(sum(p.v), 0e0))) AS v FROM ({_range(d, n)}) r LEFT JOIN ({placed}) p ON p.i = r.i GROUP BY r.i"


def presets(d) -> dict[str, str]:
    """The six clips as rows (i, v)."""
    return {
        "click": sound(d, 1800, 0.04, True, 0.25, release=0.03), "hop": sound(d, 320, 0.18, gain=0.55, slide=1.4, release=0.1),
        "bank": joined([(sound(d, 660, 0.09, gain=0.5), 0.09), (sound(d, 880, 0.09, gain=0.5), 0.09), (sound(d, 1320, 0.18, gain=0.55, release=0.15), 0.18)]),
        "crash": mixed([sound(d, 90, 0.35, gain=0.7, slide=-0.6, release=0.3), noise(d, 0.4, 0.45, 0.5)]), "rev": engine(d), "music": music(d)}


def _clip(d, name: str) -> str:
    return f"SELECT CAST(i AS BIGINT) AS i, round(v, 5) + 0e0 AS v FROM ({presets(d)[name]}) c"


@query
def clip_bank(d):
    return _clip(d, "bank")


@query
def clip_crash(d):
    return _clip(d, "crash")


@query
def clip_rev(d):
    return _clip(d, "rev")


@query
def clip_music(d):
    return f"SELECT CAST(i AS BIGINT) AS i, round(v, 4) + 0e0 AS v FROM ({presets(d)['music']}) c"


@query
def clip_sizes(d):
    """Bytes of the six files: a header of 44 and two for each sample."""
    each = " UNION ALL ".join(f"SELECT '{name}' AS clip, count(*) AS n FROM ({rows}) c{k}" for k, (name, rows) in enumerate(presets(d).items()))
    return f"SELECT clip, n AS n_samples, 44 + 2 * n AS n_bytes FROM ({each}) x"


def write_wav(samples, path: str) -> int:
    """Write the rows (i, v) of one clip as 16-bit mono; the number of samples.  Clips are
    seconds long, so their samples fit the driver."""
    import wave

    rows = samples.selectExpr("i", "CAST(greatest(-1D, least(1D, v)) * 32767 AS INT) AS pcm").orderBy("i").toPandas()
    with wave.open(path, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(RATE)
        out.writeframes(rows["pcm"].to_numpy("<i2").tobytes())
    return len(rows)


@query
def tone_samples(d):
    return f"SELECT CAST(i AS BIGINT) AS i, round(v, 6) AS v, CAST(greatest(-1e0, least(1e0, round(v, 6))) * 32767 AS INT) AS pcm FROM ({tone(d, 440.0, 0.5, slide=0.25)}) t" if d.name == "spark" else f"SELECT CAST(i AS BIGINT) AS i, round(v, 6) AS v, CAST(trunc(greatest(-1e0, least(1e0, round(v, 6))) * 32767) AS INT) AS pcm FROM ({tone(d, 440.0, 0.5, slide=0.25)}) t"


@query
def mix_samples(d):
    """The sum of three voices, the shorter ones padded with silence."""
    voices = " UNION ALL ".join(f"SELECT i, v FROM ({tone(d, f, s, 0.3, square=q)}) v{k}" for k, (f, s, q) in enumerate(((330.0, 0.4, False), (495.0, 0.3, False), (110.0, 0.5, True))))
    return f"SELECT CAST(i AS BIGINT) AS i, round(greatest(-1e0, least(1e0, sum(v))), 6) AS v FROM ({voices}) a GROUP BY i"


@query
def sweep_phase(d):
    """A rising power sweep: the phase is the running sum of the frequency."""
    n = RATE // 2
    return f"SELECT CAST(i AS BIGINT) AS i, round(phase, 4) AS phase FROM (SELECT i, sum({2 * math.pi / RATE!r}e0 * (80e0 + 400e0 * pow(i / {n}e0, 1.7e0))) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase FROM ({_range(d, n)}) r) x"
