"""A small corpus with nulls, empty and long texts, copies, near copies, shared passages and clashing column names."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string, t string, fp long, "
    "component_id string, place int, size string, target string, rate string, cell string, g string"
)
LABELS = "doc_id long, quality int, toxic int, k string, y int"
SYLLABLES = {"en": "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou".split(),
             "fr": "le la es en on re ou ai é è que eau aux tion ment oi an un du des".split()}


def words(rng, n, lang="en"):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n, lang="en"):
    w = words(rng, n, lang)
    return "".join(x + ("\n" if i % 17 == 16 else " ") for i, x in enumerate(w)).strip()


def documents(seed=5, n=60):
    """(doc_id, text, lang, source) rows."""
    rng = random.Random(seed)
    passage = prose(rng, 120)
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        text = prose(rng, rng.randint(1, 150), lang)
        if i % 7 == 3:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 9 == 4:
            text = text + "\n" + passage + "\n" + prose(rng, 30)
        rows.append([i, text, lang, f"s{i % 4}"])
    rows[10][1] = rows[8][1]
    rows[12][1] = rows[8][1]
    near = prose(rng, 400).split(" ")
    rows[20][1] = " ".join(near)
    rows[22][1] = " ".join(near[:200] + ["changed"] + near[201:])
    rows[24][1] = prose(rng, 6000)
    rows[26][1] = "ab " * 700
    rows[28][1] = "é" * 500 + " <|im_end|> <|endoftext|> x"
    rows[30][1] = None
    rows[32][1] = ""
    rows[34][1] = " \n\t "
    rows[36][3] = None
    rows[38][2] = None
    rows[40][1] = "12345 !!! 67"
    rows.append(list(rows[8]))  # the same row again
    rows.append([None, "no id here at all", "en", "s1"])
    return rows


def frame(spark, rows):
    extra = (7.5, "k", "t", 3, "c", 1, "z", "a", "b", "e", "g")
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(rows):
    return [(r[0], 0 if "$$$" in (r[1] or "") else 1, 0, "x", 1) for r in rows if r[0] is not None and r[0] % 3 != 1] + [
        (None, 1, 0, "x", 1),
        (5, None, None, "x", 1),
    ]
