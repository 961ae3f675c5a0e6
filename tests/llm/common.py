"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, part int, piece string, _salt int, start int, length string"


def rows():
    texts = [None, "", "a", " ", "\n\n", "One two three.\nOne two three.\n", "x " * 3000, "é ñ ß İ", "same text here", "same text here", "tab\tand\r\nline", "<|endoftext|> in text"]
    out = [(i, t, "en", f"src{i % 3}", len(t or ""), "t", 1, "p", 2, 3, "l") for i, t in enumerate(texts)]
    out += [(8, "same text here", None, None, None, None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark, more=()):
    return spark.createDataFrame([*rows(), *more], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def twins(power, a="a", b="b"):
    """A Thue-Morse text of 2**power symbols and its complement, which polynomial hashes modulo 2**64 take for one from power 10 on."""
    bits = [k.bit_count() & 1 for k in range(1 << power)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)
