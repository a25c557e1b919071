import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, component STRING, rule STRING"


def made_texts(seed=3, n=120):
    """Texts with copies, near copies, shared passages, odd white space, junk and personal data."""
    draw = random.Random(seed)
    say = lambda k: " ".join("".join(draw.choices("abcdefgé", k=draw.randint(1, 7))) for _ in range(k))
    passage, line = say(60), say(12)
    texts = []
    for i in range(n):
        kind = i % 12
        text = say(draw.randint(20, 200))
        if kind == 1 and texts:
            text = texts[draw.randrange(len(texts))] or ""
        elif kind == 2 and texts:  # a near copy
            words = (texts[draw.randrange(len(texts))] or "x").split(" ")
            words[draw.randrange(len(words))] = "other"
            text = " ".join(words).upper() if draw.random() < 0.3 else " ".join(words)
        elif kind == 3:
            text = f"{say(draw.randint(0, 30))}\n{passage}\t{say(draw.randint(0, 30))}"
        elif kind == 4:
            text = f"{line}\n{text}\n{line}"
        elif kind == 5:
            text = ("spam " * draw.randint(1, 80)).strip()
        elif kind == 6:
            text = f"{say(9)} ana.{i}@mail{i}.example.com, 10.0.{i}.7 and +1 (045) 555-32{i % 90 + 10} {say(5)} 4111 1111 1111 1111"
        elif kind == 7:
            text = f'{say(20)} token = "{draw.randrange(16**40):040x}" {say(4)} {draw.randrange(10**15, 10**16)}'
        elif kind == 9:
            text += " " + "".join(draw.choices("abcdefgh", k=draw.randint(24, 60))) + " end"
        elif kind == 8:
            text = " \x0b ".join(text.split(" ")) + "\x0c\r\n"
        texts.append(text)
    return [*texts, "", None, " \n\t ", "a", "a b c d", "A b C d", "  x", "日本 🙂 text", None, ""]


@pytest.fixture(scope="session")
def doc_rows():
    return list(enumerate(made_texts()))


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """Documents with extra columns whose names clash with those used inside."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "x", "y") for i, t in doc_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
