import random
from pathlib import Path

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "tu", "sha", "ren") for b in ("n", "st", "ra", "ly", "do", "wic")]


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def edited(text: str, seed: int, n: int = 1) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


#: Nulls, emptiness, ties, repeated rows, a very long text, control and wide characters.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s0", 0),
    (3, " \n\t ", "en", "s0", 4),
    (4, "one", "en", "s1", 3),
    (5, "one two", "en", "s1", 7),
    (6, "One two three \U0001d11e ▁x <s>", "fr", "s1", 20),
    (7, prose(7), "en", "s2", None),
    (7, prose(7), "en", "s2", None),
    (8, prose(7), "en", "s0", None),
    (None, prose(9), "en", "s0", None),
    (10, prose(10, 40_000), "en", None, None),
    (11, 'x password = "hunter22" y\r\n\x00z', "en", "", None),
]


def in_duckdb(folder: str, sql: str, columns: list[str]) -> list[tuple]:
    duck = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    return sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


def rows_of(frame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
