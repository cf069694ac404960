import random
import string

import pytest

from rasterflow.llm import secrets
from rasterflow.llm.queries import BYTE_BPE, PATTERN

RATIO = secrets.TokenEfficiency(BYTE_BPE, PATTERN)
TOKEN = "q8Zr2LwX0vNt7KdPy4Hb9Jm3"


def found(text):
    return [text[a:b] for a, k, b in secrets.scan(text, RATIO)[1] if secrets.KINDS[k] == "random"]


def test_random_part_beside_a_base_span():
    assert found(f"https://files.example.com/9f86d081884c7d65/{TOKEN}") == [TOKEN]


@pytest.mark.parametrize("path", ["documents/download/session/", "public/documents/download/archive/session/"])
def test_random_part_of_a_path(path):
    r = random.Random(1)
    keys = ["".join(r.choices(string.ascii_letters + string.digits, k=24)) for _ in range(200)]
    assert sum(any(k in s for s in found(f"https://example.com/{path}{k} end")) for k in keys) >= 190


def test_short_random_strings():
    r = random.Random(2)
    for n in (16, 19):
        keys = ["".join(r.choices(string.ascii_letters + string.digits, k=n)) for _ in range(200)]
        assert sum(found(f"key {k} end") == [k] for k in keys) >= 185


def test_names_are_not_random():
    text = "2024-01-15T10-22-33Z docs/v2/api3/list utf8mb4_unicode_ci getElementById2x"
    assert found(text) == []
