"""Plain-Python versions of the text rules, for the tests."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def low(b):
    return b.lower()


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
