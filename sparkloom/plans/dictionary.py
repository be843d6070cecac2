"""A small dictionary with frequencies."""

UNIGRAM_WORDS = {"▁the": 900.0, "▁of": 500.0, "▁and": 500.0, "the": 90.0, "tion": 80.0, "ing": 80.0, "an": 60.0, "er": 60.0, "en": 50.0, "on": 50.0, "es": 40.0, "▁": 300.0, "e": 30.0, "a": 20.0, "n": 20.0, "t": 20.0, "r": 20.0, "s": 20.0, "i": 20.0, "o": 20.0, ".": 9.0}
