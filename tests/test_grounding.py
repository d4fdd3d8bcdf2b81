from __future__ import annotations

from mailquarry.functions.grounding import ground, merged_alternatives

SOURCE = "Dear client,\nplease  confirm your account “today” at the branch – or it will be closed. Visit us."


def test_cascade():
    assert ground('account "TODAY" at', SOURCE) == "exact"
    assert ground("'please confirm your account…'", SOURCE) == "core"
    assert ground("pay.example.test", SOURCE, ["example.test"]) == "host"
    assert ground("Visit us <https://x.test>", SOURCE) == "caption"
    near = "please confirm your acount today at the branch"
    assert ground(near, SOURCE) is None and ground(near, SOURCE, context=True) == "fuzzy"
    long = "it says that you must confirm your account “today” at the branch – or it will be something else entirely"
    assert ground(long, SOURCE, context=True) in ("fuzzy", "run")
    assert ground("nothing of the sort", SOURCE, context=True) is None
    assert ground("", SOURCE) is None and ground("x", None) is None


def test_alternatives():
    plain, page = "Hello\n\nPay here https://a.test", "Hello\n\nPay here https://b.test/?x=1\n\nHidden offer\n\nBye"
    out = merged_alternatives(plain, page)
    assert out == "Hello\n\nPay here https://a.test\n\n[only in the alternative version]\n\nPay here https://b.test/?x=1\n\nHidden offer\n\nBye"
    assert merged_alternatives(plain, plain.upper()) == plain and merged_alternatives(None, "x") == "x" and merged_alternatives("x", None) == "x"
