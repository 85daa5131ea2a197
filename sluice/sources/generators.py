"""Seeded value generators, exact to the draw: each column has its own generator for each shard.

A column's seed starts a generator that gives each shard its own seed, so values depend on the column's seed and the number of shards
only. Null is drawn before the value, and only where nulls are wanted.
"""

from __future__ import annotations

import datetime as dt
import importlib.util
import random
import string
import sys
import uuid as uuid_lib
from itertools import accumulate

EPOCH = dt.datetime(1970, 1, 1)
#: What the byte values 0 to 255 become in texts (113 lower, 30 digits, 113 upper) and in hexadecimal strings (160 letters, 96 digits).
LETTERS = ((string.ascii_lowercase * 5)[:113] + string.digits * 3 + (string.ascii_uppercase * 5)[:113]).encode()
HEX_DIGITS = (("abcdef" * 27)[:160] + (string.digits * 10)[:96]).encode()


class Generator:
    def __init__(self, seed, null_pct: float = 0.0, array: int = 0):
        self.rng = random.Random(seed)
        self.null_pct, self.array = null_pct or 0.0, array or 0

    def one(self):
        raise NotImplementedError

    def __iter__(self):
        return self

    def __next__(self):
        if self.null_pct and self.rng.random() < self.null_pct:
            return None
        if not self.array:
            return self.one()
        return "{" + ",".join(str(self.one()) for _ in range(self.array)) + "}"


class Constant(Generator):
    def __init__(self, value="constant", seed=None, **kw):
        super().__init__(seed, **kw)
        self.value = value

    def one(self):
        return self.value


class Sequence(Generator):
    def __init__(self, start: int = 0, seed=None, **kw):
        super().__init__(seed)
        self.at = start - 1

    def one(self):
        self.at += 1
        return self.at


class Uuid(Generator):
    def one(self):
        return str(uuid_lib.UUID(int=self.rng.getrandbits(128), version=4))


class Timestamp(Generator):
    def __init__(self, start="2000-01-01", end="2024-12-31", format="%Y-%m-%d %H:%M:%S.%f", seed=None, **kw):  # noqa: A002
        super().__init__(seed, **kw)
        self.lo, self.hi = (round((dt.datetime.fromisoformat(x) - EPOCH) / dt.timedelta(microseconds=1)) for x in (start, end))
        self.format = format

    def one(self):
        return (EPOCH + dt.timedelta(microseconds=self.rng.randint(self.lo, self.hi))).strftime(self.format)


class Date(Timestamp):
    def __init__(self, start="2000-01-01", end="2024-12-31", format="%Y-%m-%d", **kw):  # noqa: A002
        super().__init__(start, end, format, **kw)


class Time(Timestamp):
    def __init__(self, start="07:30:00", end="22:30:00", micros: bool = False, **kw):
        super().__init__(f"1970-01-01T{start}", f"1970-01-01T{end}", "%H:%M:%S.%f" if micros else "%H:%M:%S", **kw)


class String(Generator):
    def __init__(self, min: int = 10, max: int = 50, prefix: str = "", seed=None, **kw):  # noqa: A002
        super().__init__(seed, **kw)
        self.min, self.max, self.prefix = min, max, prefix

    def body(self, size: int) -> str:
        return self.rng.getrandbits(8 * size).to_bytes(size, "big").translate(LETTERS).decode() if size > 0 else ""

    def __next__(self):
        if self.null_pct and self.rng.random() < self.null_pct:
            return None
        size = self.rng.randint(self.min, self.max)
        if not self.array:
            return self.prefix + self.body(size)
        return "{" + ",".join(self.prefix + self.body(size) for _ in range(self.array)) + "}"


class Json(String):
    def __init__(self, min: int = 10, max: int = 50, **kw):  # noqa: A002
        # of the length, nine characters are the object around the text
        super().__init__(min - 9 if min > 10 else 1, max - 9 if max > 11 else 2, **{k: v for k, v in kw.items() if k != "array"})

    def __next__(self):
        body = super().__next__()
        return body if body is None else f'{{"k":"{body}"}}'


class Integer(Generator):
    def __init__(self, min: int = 1, max: int = 1_000_000_000, seed=None, **kw):  # noqa: A002
        super().__init__(seed, **kw)
        self.min, self.max = min, max

    def one(self):
        return self.rng.randint(self.min, self.max)


class Bit(Generator):
    def __init__(self, size: int = 1, seed=None, **kw):
        super().__init__(seed, **kw)
        self.size = size

    def one(self):
        return "".join("1" if self.rng.random() > 0.5 else "0" for _ in range(self.size))


class Bool(Generator):
    def one(self):
        return 1 if self.rng.random() > 0.5 else 0


class Float(Generator):
    def __init__(self, min: float = 0, max: float = 1_000_000, round: int = 2, seed=None, **kw):  # noqa: A002
        super().__init__(seed, **kw)
        self.min, self.max, self.digits = min, max, round

    def one(self):
        return round(self.rng.uniform(self.min, self.max - 1), self.digits)


class Bytes(Generator):
    def __init__(self, size: int = 20, seed=None, **kw):
        super().__init__(seed, **kw)
        self.size = size

    def one(self):
        digits = self.rng.getrandbits(8 * self.size).to_bytes(self.size, "big").translate(HEX_DIGITS).decode()
        return f'"\\\\x{digits}"' if self.array else f"\\x{digits}"


class Choice(Generator):
    def __init__(self, population, weights=None, cum_weights=None, seed=None, **kw):
        super().__init__(seed, **kw)
        self.population, self.cum = population, cum_weights or (list(accumulate(weights)) if weights else None)

    def one(self):
        return self.rng.choices(self.population, cum_weights=self.cum)[0]


KINDS = {
    "constant": Constant, "sequence": Sequence, "uuid": Uuid, "timestamp": Timestamp, "date": Date, "time": Time, "string": String, "json": Json,
    "integer": Integer, "bit": Bit, "bool": Bool, "float": Float, "bytes": Bytes, "choice": Choice,
}


def load_custom(path: str):
    """A user's generator class from a file: the class named like the file, Camel or upper case."""
    name = path.rsplit("/", 1)[-1].removesuffix(".py")
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    sys.modules[name] = mod
    spec.loader.exec_module(mod)
    camel = "".join(p.capitalize() for p in name.split("_"))
    return getattr(mod, camel, None) or getattr(mod, name.upper())


def shard_seeds(seed, shards: int) -> list:
    """A seed for each shard, drawn from the column's seed; without one, of the system's entropy."""
    rng = random.Random(seed)
    return [rng.random() for _ in range(shards)]


def make(kind: str, args: dict, shard: int, shards: int, count: int):
    """The generator of a column in one shard."""
    args = dict(args)
    seed = shard_seeds(args.pop("seed", None), shards)[shard]
    if kind == "sequence":
        return Sequence(args.get("start", 0) + int(count / shards) * shard)
    if kind == "custom":
        return load_custom(args.pop("path"))(seed, **args)
    return KINDS[kind](seed=seed, **args)
