"""A character-level bidirectional LSTM with CRF transitions, in numpy, and the labelled spans it learns from.

``load`` gives the weights that ``train`` made, kept beside this module under a key of all that training depends on;
``python -m tracewise.llm.tagger`` makes them anew. Where the key does not fit, as after a change of the examples,
``load`` trains.
"""

from __future__ import annotations

import hashlib
import os
import string
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN, LENGTH = 10, 16, 128
#: Bounds of training: labelled texts, passes over them, texts in a batch, and the seed of all that is random.
EXAMPLES, PASSES, BATCH, SEED, RATE = 8000, 12, 48, 7, 0.02
#: By how much other tags must be behind for a window to be untagged for certain: far more than rounding makes of its score.
MARGIN = np.float32(1)
#: Where the trained weights are kept.
STORED = os.path.join(os.path.dirname(__file__), "tagger_weights.npz")

_MARKS = "@.-_+%()[]:/ ,\n\"'=#"
_PLACE = {c: i + 4 for i, c in enumerate(string.ascii_lowercase + _MARKS)}
ALPHABET = 4 + len(_PLACE)


def _symbols() -> np.ndarray:
    """Symbol of each character below U+0250: digits are one, as are letters and other characters beyond ASCII."""
    return np.array([_symbol(chr(i)) for i in range(0x250)], np.int64)


def _symbol(c: str) -> int:
    return 1 if c in string.digits else _PLACE.get(c.lower(), 2 if c.isalpha() else 3)


_LOW = np.append(_symbols(), 2).astype(np.uint8)


def encode(text: str) -> np.ndarray:
    """The text's symbols; 0 is kept for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _LOW[np.minimum(points, len(_LOW) - 1)]


# Labelled spans ------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether the digits' weighted sum is divisible by ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _of(rng, choices):
    return choices[rng.integers(0, len(choices))]


def _word(rng, low: int = 1, high: int = 9, letters: str = string.ascii_lowercase) -> str:
    return "".join(rng.choice(list(letters), rng.integers(low, high + 1)))


_HEADS, _HEARTS, _TAILS = "b c d f g h j k l m n p r s t v w st th ch pl".split() + [""], "a e i o u ou ea io é ñ ü".split(), "n r s t l nd ng st".split() + ["", "", ""]


# Some of the most common words of four languages, which prose is full of.
_COMMON = (
    "the of and to a in is it that for on with as at by from this be are was or an not he she they we you i have has had do did go goes went then there here when while word words what who how why all some any one two "
    "no yes if so but up out about into over after before again more most other new old long little own same know think take see come could would should will can may might must made make place work year day time way "
    "call me mail ask send write number phone card please contact reach le la les un une de des du et est que qui dans pour pas sur avec au aux ce cette il elle nous vous el los las uno del y en por con para se lo su como más "
    "der die das ein eine und ist nicht mit auf für von zu den dem sie wir ich es auch als bei nach"
).split()


def _spoken(rng) -> str:
    """A common word, or a made-up one of one to four syllables."""
    if rng.random() < 0.55:
        return _of(rng, _COMMON)
    return "".join(_of(rng, _HEADS) + _of(rng, _HEARTS) + _of(rng, _TAILS) for _ in range(rng.integers(1, 5)))


def _ascii(text: str) -> str:
    return "".join(c for c in text if c in string.ascii_lowercase) or "x"


def _plain(rng) -> str:
    """A name or label in ASCII letters."""
    return _word(rng, 2, 9) if rng.random() < 0.5 else _ascii(_spoken(rng)) + _of(rng, ["", "a", "e", "o"])


def _email(rng) -> str:
    name = _plain(rng) + _of(rng, ["", "", "." + _plain(rng), "_" + _plain(rng), "-" + _plain(rng), _digits(rng, 2), "." + _digits(rng, 2)])
    at, dot = _of(rng, [("@", "."), ("@", "."), (" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" [at] ", "."), ("[at]", "."), ("\tat\t", "\tdot\t"), (" at\n", " dot ")])
    most = 10 if rng.random() < 0.15 else 2
    host = [_plain(rng) + _of(rng, ["", "", _digits(rng, 1)]) for _ in range(rng.integers(1, most + 1))]
    whole = name + at + dot.join([*host, _of(rng, ["com", "org", "net", "edu", "de", "fr", "es", "io", "info", _word(rng, 2, 4)])])
    return _of(rng, [whole, whole, whole, whole.upper()])


def _ip(rng) -> str:
    parts = [str(rng.integers(0, 256) if rng.random() < 0.8 else _of(rng, [0, 1, 10, 127, 192, 255])) for _ in range(4)]
    return _of(rng, [".", ".", "[.]", "(.)", " . ", " dot ", "[dot]", "-dot-"]).join(parts)


def _card(rng) -> str:
    head = _of(rng, "3456") + _digits(rng, int(_of(rng, [14, 14, 14, 13, 12, 11])))
    digits = next(head + c for c in string.digits if luhn(head + c))
    gap = _of(rng, ["", " ", "-", ".", "_", "/", "  ", " - "])
    sizes = (4, 6, 5) if len(digits) == 15 else (4, 4, 4, 4)
    ends = np.cumsum((0, *sizes)).tolist()
    return gap.join(x for a, b in zip(ends, ends[1:], strict=False) if (x := digits[a:b]))


def _phone(rng) -> str:
    a, b, c, d = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), _digits(rng, 2)
    country, area = str(rng.integers(1, 99)), "0" + _digits(rng, int(rng.integers(2, 4)))
    forms = [
        f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}{a}{b}{c}", f"+{country}-{a}-{b}-{c}", f"+{country} {a} {b}{c}",
        f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"({a}) {b}.{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}",
        f"00{country} {a} {b} {c}", f"{area}/{b}{c}", f"{area} {b} {c}", f"{area} {d} {d} {d} {c[:2]}", f"{area}-{b}{c}", f"({area}) {b} {c}", f"({area}) {b}{c}",
    ]
    return _of(rng, forms)


def _other(rng) -> str:
    """What looks a little like personal data and is none."""
    hexed = _word(rng, 12, 40, "0123456789abcdef")
    month = _of(rng, ["May", "June", "Jan", "mars", "abril"])
    forms = [
        _digits(rng, int(rng.integers(1, 8))), _digits(rng, int(rng.integers(8, 22))), f"{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}",
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2100)}",
        f"{rng.integers(1, 29)} {month} {rng.integers(1900, 2100)}", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02}", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02}:{rng.integers(0, 60):02}",
        f"${rng.integers(1, 999)},{_digits(rng, 3)}", f"{_digits(rng, 3)}.{_digits(rng, 6)}", f"{rng.integers(10, 99)}-{rng.integers(100, 200)}", f"({rng.integers(1, 99)})", f"[{rng.integers(1, 99)}]", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}",
        f'token = "{hexed}"', f"password={hexed}", f"secret: {_word(rng, 8, 20)}", hexed, "at", "dot", f"{_spoken(rng)} at {_spoken(rng)}", f"{_spoken(rng)} at {_spoken(rng)} {_spoken(rng)}", f"at the {_spoken(rng)} dot", f"dot {_spoken(rng)}", f"{_spoken(rng)} (at) {_spoken(rng)}", f"@{_plain(rng)}", f"{_plain(rng)}@", f"AKIA{_word(rng, 16, 16, string.ascii_uppercase + string.digits)}",
        f"#{_digits(rng, 5)}", f"No. {_digits(rng, 6)}", f"https://{_plain(rng)}.com/{_plain(rng)}/{_digits(rng, 3)}", f"{_plain(rng)}.{_plain(rng)}()", f"{_plain(rng)}[{rng.integers(0, 9)}]", " ".join(str(x) for x in rng.integers(0, 99, 5)), ", ".join(str(x) for x in rng.integers(0, 999, 4)),
    ]
    return _of(rng, forms)


def example(rng) -> tuple[str, np.ndarray]:
    """A text of ``LENGTH`` characters at most, and the tag of each. A span cut at the front goes on as the inside of one."""
    makers = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
    rich, cut_at = rng.random() < 0.6, int(rng.integers(0, 24))
    text, tags = "", []
    while len(text) < LENGTH + cut_at:
        roll = rng.random()
        if roll < (0.16 if rich else 0.02):
            kind = _of(rng, KINDS)
            piece = makers[kind](rng)
            own = [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(piece) - 1)
        else:
            piece = _other(rng) if roll < (0.3 if rich else 0.1) else _spoken(rng) + _of(rng, ["", "", "", "", ",", ".", "!!", "###", "$$$", ";", "?"])
            piece = _of(rng, [piece, piece, piece, piece.capitalize(), piece.upper()])
            own = [0] * len(piece)
        gap = _of(rng, [" ", " ", " ", " ", " ", " ", " ", " ", "\n", ": ", ", ", ". "])
        text, tags = text + piece + gap, tags + own + [0] * len(gap)
    return text[cut_at : cut_at + LENGTH], np.array(tags[cut_at : cut_at + LENGTH])


# Network -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Parameters by name."""

    held: dict[str, np.ndarray] = field(hash=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.held[name]

    @cached_property
    def fused(self) -> dict[str, np.ndarray]:
        """Per direction one matrix over (state, embedding, 1), negative, and doubled where a gate is no sigmoid: tanh(x) is 2 / (1 + exp(-2 x)) - 1."""
        half = -np.r_[np.ones(3 * HIDDEN), np.full(HIDDEN, 2)].astype(np.float32)
        return {side: np.ascontiguousarray((np.vstack([self[f"h{side}"], self[f"x{side}"], self[f"c{side}"]]) * half).T, np.float32) for side in "fb"}


def _fresh(rng) -> dict[str, np.ndarray]:
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    held = {"embed": rng.normal(0, 0.5, (ALPHABET, EMBED)), "out": scale(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
    for side in "fb":
        held |= {f"x{side}": scale(EMBED, 4 * HIDDEN), f"h{side}": scale(HIDDEN, 4 * HIDDEN), f"c{side}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(w, side: str, symbols: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, (time, batch, hidden), and what the backward pass needs."""
    drive = (w["embed"] @ w[f"x{side}"] + w[f"c{side}"])[symbols]
    h = c = np.zeros((symbols.shape[1], HIDDEN), drive.dtype)
    out, past = np.zeros((*symbols.shape, HIDDEN), drive.dtype), []
    for t in range(len(symbols)) if side == "f" else range(len(symbols) - 1, -1, -1):
        z = drive[t] + h @ w[f"h{side}"]
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before = c
        c = f * c + i * new
        squashed = np.tanh(c)
        if keep:
            past.append((t, h, before, i, f, o, new, squashed))
        h = o * squashed
        # Padding leaves the state empty, so that a text means the same whatever stands beside it.
        real = (symbols[t] > 0)[:, None]
        h, c = h * real, c * real
        out[t] = h
    return out, past


def _lstm_back(w, side: str, symbols: np.ndarray, past: list, from_out: np.ndarray, grads: dict) -> None:
    dh = dc = np.zeros((symbols.shape[1], HIDDEN), from_out.dtype)
    table = np.zeros((ALPHABET, 4 * HIDDEN))
    for t, h, before, i, f, o, new, squashed in reversed(past):
        real = (symbols[t] > 0)[:, None]
        dh = (dh + from_out[t]) * real
        dc = dc * real + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
        grads[f"h{side}"] += h.T @ dz
        np.add.at(table, symbols[t], dz)
        dh, dc = dz @ w[f"h{side}"].T, dc * f
    grads[f"c{side}"] += table.sum(0)
    grads[f"x{side}"] += w["embed"].T @ table
    grads["embed"] += table @ w[f"x{side}"].T


def _emissions(w, symbols: np.ndarray, keep: bool = False):
    ahead, past_f = _lstm(w, "f", symbols, keep)
    back, past_b = _lstm(w, "b", symbols, keep)
    both = np.concatenate([ahead, back], axis=2)
    return both @ w["out"] + w["bias"], both, past_f, past_b


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _step(w: dict, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags, and its gradients. All texts are of full length here."""
    score, both, past_f, past_b = _emissions(w, symbols, keep=True)
    time, batch = symbols.shape
    ahead, back = np.zeros_like(score), np.zeros_like(score)
    ahead[0] = score[0] + w["first"]
    for t in range(1, time):
        ahead[t] = _logsum(ahead[t - 1][:, :, None] + w["move"], 1) + score[t]
    for t in range(time - 2, -1, -1):
        back[t] = _logsum(w["move"] + (score[t + 1] + back[t + 1])[:, None, :], 2)
    whole = _logsum(ahead[-1], 1)
    each = np.arange(batch)
    gold = w["first"][tags[0]].sum() + sum(score[t][each, tags[t]].sum() for t in range(time)) + sum(w["move"][tags[t - 1], tags[t]].sum() for t in range(1, time))
    d_score = np.exp(ahead + back - whole[:, None])
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    pair = np.exp(ahead[:-1][:, :, :, None] + w["move"] + (score + back)[1:][:, :, None, :] - whole[:, None, None])
    grads["move"] = pair.sum((0, 1))
    np.add.at(grads["move"], (tags[:-1].ravel(), tags[1:].ravel()), -1)
    grads["first"] = d_score[0].sum(0) - np.bincount(tags[0], minlength=TAGS)
    np.subtract.at(d_score, (np.repeat(np.arange(time), batch), np.tile(each, time), tags.ravel()), 1)
    grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_score.reshape(-1, TAGS)
    grads["bias"] = d_score.sum((0, 1))
    d_both = d_score @ w["out"].T
    _lstm_back(w, "f", symbols, past_f, d_both[:, :, :HIDDEN], grads)
    _lstm_back(w, "b", symbols, past_b, d_both[:, :, HIDDEN:], grads)
    return float(whole.sum() - gold) / batch, {k: v / batch for k, v in grads.items()}


def train(examples: int = EXAMPLES, passes: int = PASSES, seed: int = SEED) -> Weights:
    """Weights learned from made-up labelled texts; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    made = [example(rng) for _ in range(examples)]
    symbols, tags = np.stack([encode(t) for t, _ in made], 1), np.stack([g for _, g in made], 1)
    w = {k: v.astype(np.float32) for k, v in _fresh(rng).items()}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    turn, turns = 0, passes * (len(made) // BATCH)
    for _ in range(passes):
        order = rng.permutation(len(made))
        for at in range(0, len(made) - BATCH + 1, BATCH):
            part = order[at : at + BATCH]
            _, grads = _step(w, symbols[:, part], tags[:, part])
            size = np.sqrt(sum((g**2).sum() for g in grads.values()))
            turn += 1
            for k, g in grads.items():
                g = (g * min(1, 5 / size)).astype(np.float32)
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.01) * (g**2 - square[k])
                rate = np.float32(RATE * (1 - 0.95 * turn / turns) / (1 - 0.9**turn))
                w[k] -= rate * mean[k] / (np.sqrt(square[k] / np.float32(1 - 0.99**turn)) + np.float32(1e-8))
    return Weights(w)


def key() -> str:
    """A digest of what training depends on: its bounds, the network's sizes, and examples of another seed."""
    rng = np.random.default_rng(SEED + 1)
    seen = [(text, tags.tolist()) for text, tags in (example(rng) for _ in range(50))]
    return hashlib.sha256(repr((EMBED, HIDDEN, LENGTH, ALPHABET, EXAMPLES, PASSES, BATCH, SEED, RATE, seen)).encode()).hexdigest()


@lru_cache(maxsize=1)
def load(path: str = STORED) -> Weights:
    """The stored weights if they are those of ``train()``, else trained now."""
    if os.path.exists(path):
        with np.load(path) as held:
            if str(held["key"]) == key():
                return Weights({k: held[k] for k in held.files if k != "key"})
    return train()


def _alive(sizes: np.ndarray) -> list[int]:
    """How many windows, which stand longest first, reach each place."""
    return np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right").tolist()


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += np.float32(1)
    return np.divide(np.float32(1), x, out=x)


@np.errstate(over="ignore")
def _scores(w: Weights, symbols: np.ndarray, alive: list[int]) -> np.ndarray:
    """Emissions (time, tag, window); of those windows that reach a place."""
    longest, count = symbols.shape
    one, two = np.float32(1), np.float32(2)
    embed = np.ascontiguousarray(w["embed"], np.float32)
    score = np.zeros((longest, TAGS, count), np.float32)
    for side, out in (("f", w["out"][:HIDDEN]), ("b", w["out"][HIDDEN:])):
        out, matrix = np.ascontiguousarray(out.T, np.float32), w.fused[side]
        held, cell = np.zeros((HIDDEN + EMBED + 1, count), np.float32), np.zeros((HIDDEN, count), np.float32)
        held[-1] = 1
        for t in range(longest) if side == "f" else range(longest - 1, -1, -1):
            n = alive[t]
            held[HIDDEN:-1, :n] = np.take(embed, symbols[t, :n], axis=0).T
            # Sigmoids by numpy's exponential, which takes two thirds of the time of its tanh here. Beyond its range it is infinite, and they are 0.
            z = _sigmoid_of_negative(matrix @ held[:, :n])
            new, c = z[3 * HIDDEN :], cell[:, :n]
            new *= two
            new -= one
            c *= z[HIDDEN : 2 * HIDDEN]
            new *= z[:HIDDEN]
            c += new
            squashed = _sigmoid_of_negative(c * -two)
            squashed *= two
            squashed -= one
            np.multiply(squashed, z[2 * HIDDEN : 3 * HIDDEN], out=held[:HIDDEN, :n])
            if side == "f":
                np.add(out @ held[:HIDDEN, :n], w["bias"][:, None], out=score[t, :, :n])
            else:
                score[t, :, :n] += out @ held[:HIDDEN, :n]
    return score


def _viterbi(w: Weights, score: np.ndarray, alive: list[int]) -> np.ndarray:
    """The best tags (time, window) by the CRF's transitions. The way back looks up the moves anew, of one tag each."""
    longest, _, count = score.shape
    move = w["move"].astype(np.float32)
    score[0] += w["first"][:, None].astype(np.float32)
    for t in range(1, longest):
        n = alive[t]
        score[t, :, :n] += (score[t - 1, :, None, :n] + move[:, :, None]).max(0)
    tags = np.zeros((longest, count), np.int8)
    for t in range(longest - 1, -1, -1):
        n, later = alive[t], alive[t + 1] if t + 1 < longest else 0
        ways = score[t, :, :n]
        if later:
            ways[:, :later] += move[:, tags[t + 1, :later]]
        best = ways[0].copy()
        for k in range(1, TAGS):
            over = ways[k] > best
            if over.any():
                tags[t, :n][over] = k
                np.maximum(best, ways[k], out=best)
    return tags


def _untagged(w: Weights, score: np.ndarray, alive: list[int]) -> np.ndarray:
    """Windows whose best tags are all 0 for certain.

    All kinds are taken as one, begin and inside, with the best score and the best moves of any: no path scores more than by these.
    """
    longest, _, count = score.shape
    move, first = w["move"].astype(np.float32), w["first"].astype(np.float32)
    begin, inside = slice(1, TAGS, 2), slice(2, TAGS, 2)
    # Moves against that from zero to zero.
    (to_b, b_b, i_b), (to_i, b_i, i_i), (b_to, i_to) = ([move[x, y].max() - move[0, 0] for x in over] for y, over in ((begin, (0, begin, inside)), (inside, (0, begin, inside)), (0, (begin, inside))))
    # By how much paths that end in another tag are ahead of the one of zeros at most. It is the best if none is ahead where it comes back, or at the end.
    in_b, in_i = (score[0, x].max(0) - score[0, 0] + (first[x].max() - first[0]) for x in (begin, inside))
    sure = np.ones(count, bool)
    for t in range(1, longest):
        n = alive[t]
        b, i, zero = in_b[:n], in_i[:n], score[t, 0, :n]
        sure[:n] &= np.maximum(b + b_to, i + i_to) < -MARGIN
        now = np.maximum(np.maximum(b + b_b, i + i_b), to_b)
        np.maximum(np.maximum(b + b_i, i + i_i), to_i, out=i)
        np.add(now, score[t, begin, :n].max(0) - zero, out=b)
        i += score[t, inside, :n].max(0) - zero
    return sure & (np.maximum(in_b, in_i) < -MARGIN)


def decode(w: Weights, windows: list[str]) -> list[np.ndarray | None]:
    """The best tags of each window; None where none of its characters is tagged."""
    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    found: list[np.ndarray | None] = [None] * len(windows)
    if not len(order):
        return found
    sizes = sizes[order]
    longest, alive = int(sizes[0]), _alive(sizes)
    symbols = encode("".join([windows[i].ljust(longest, "\0") for i in order])).reshape(-1, longest)
    score = _scores(w, np.ascontiguousarray(symbols.T), alive)
    rest = np.flatnonzero(~_untagged(w, score, alive))
    if len(rest):
        tags = np.ascontiguousarray(_viterbi(w, np.take(score[: sizes[rest[0]]], rest, axis=2), _alive(sizes[rest])).T)
        for i, own in zip(rest.tolist(), tags, strict=True):
            if own.any():
                found[order[i]] = own[: sizes[i]].copy()
    return found


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Kind, start and end of each run of one kind's tags; a begin tag starts a new one."""
    out, at = [], 0
    while at < len(tags):
        if not tags[at]:
            at += 1
            continue
        kind, end = (tags[at] - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((int(kind), at, end))
        at = end
    return out


if __name__ == "__main__":
    np.savez(STORED, key=key(), **train().held)
