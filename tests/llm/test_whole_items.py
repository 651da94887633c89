"""Quotes of long benchmark items wherever they start, and short items whole."""

import random

from sparkloom.llm import decontaminate


def found(items: list[tuple], text: str) -> set:
    return {r[1] for r in decontaminate._find(decontaminate.Index(items), [0], [text])}


def test_quotes_of_the_stated_length_are_found_wherever_they_start():
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item, least = prose(80), decontaminate.SEGMENT - int(decontaminate.SEGMENT * decontaminate.EDITS)
    assert least == 87
    texts = [f"{prose(9)} {item[at : at + least]} {prose(9)}" for at in range(len(item) - least + 1)]
    rows = decontaminate._find(decontaminate.Index([(1, item)]), list(range(len(texts))), texts)
    assert [r[0] for r in rows] == list(range(len(texts)))
    assert found([(1, item)], prose(200)) == set()


def test_short_items_are_found_whole_between_word_borders():
    items = [(1, "Is it 42?"), (2, "short"), (3, "Short!"), (None, "a b"), (5, " ?! "), (6, "x" * 29)]
    assert found(items, "So: IS it -- 42, they said") == {1}
    assert found(items, "short") == {2, 3} and found(items, "shorter ashort") == set()
    assert found(items, "z a, b") == {None} and found(items, "a bc") == set()
    assert found(items, "x" * 29) == {6} and found(items, "x" * 30) == set()
    rows = list(decontaminate._find(decontaminate.Index(items), [7, 8], ["no", "is it 42, or short"]))
    assert (8, 1, 0, 8, 1, 1, 0) in rows and (8, 2, 13, 18, 1, 1, 0) in rows and len(rows) == 3
