"""Licence notices planted whole, edited and split, found through a file's rarest words."""

import random

from frameloom.llm import license_scan

_RNG = random.Random(4)
_COMMON = "the of and or to a is in this that with for not by it as be are on you".split()


def _noise(n):
    return " ".join(_RNG.choice([*_COMMON, *(f"word{i}" for i in range(60))]) for _ in range(n))


def test_every_notice_is_found_wherever_it_stands():
    index = license_scan.LicenseIndex()
    index.weigh({w.encode(): 0.1 for w in _COMMON})
    for label, notice, phrase in license_scan.TEMPLATES:
        for before in (0, 1, 300):
            got = index.scan(f"{_noise(before)} {notice.upper()}. {_noise(200)}")
            assert label in got["labels"].split(","), notice
            assert any(m["label"] == label and m["word"] == before and m["share"] == 1 for m in got["matches"])
        words, kept = notice.split(), phrase.split()
        edited = " ".join(w if w in kept or _RNG.random() > 0.1 else "changed" for w in words)
        if sum(a == b for a, b in zip(edited.split(), words)) > 0.8 * len(words):
            assert label in index.scan(_noise(50) + " " + edited)["labels"].split(","), edited


def test_words_of_a_notice_without_its_order_are_none():
    index = license_scan.LicenseIndex()
    for _, notice, _ in license_scan.TEMPLATES:
        words = notice.split()
        assert index.scan(" x ".join(words[::-1]))["matches"] == []
    assert index.scan(_noise(5_000))["labels"] == "" and index.scan(None)["labels"] == ""


def test_two_notices_in_one_file_do_not_hide_each_other():
    index = license_scan.LicenseIndex()
    by_label = {}
    for label, notice, _ in license_scan.TEMPLATES:
        by_label.setdefault(label, notice)
    whole = f" {_noise(30)} ".join(by_label.values())
    assert set(by_label) <= set(index.scan(whole)["labels"].split(","))


def test_candidates_come_from_the_rarest_words_of_the_file():
    index = license_scan.LicenseIndex()
    index.weigh({b"mit": 9.0, b"license": 2.0, b"the": 0.1, b"under": 0.5, b"released": 5.0})
    k = next(i for i, t in enumerate(license_scan.TEMPLATES) if t[1] == "released under the mit license")
    assert [w for w, _ in index.candidates({b"the", b"under", b"license", b"released", b"mit", b"other"})[k]] == [b"mit", b"released", b"license", b"under"]
    assert k not in index.candidates({b"other"})
