"""Texts that tests share."""


def thue_morse(n=1024):
    """A word over a and b, and its complement: polynomials modulo 2**64 don't tell them apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))
