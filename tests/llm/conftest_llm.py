"""What the tests of this folder share."""

import re

DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER) if lower else text or "")
