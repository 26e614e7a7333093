"""Operators on single rows: exact round trips and brute force."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from modalis.llm import edits, langid, licenses, packing, templates, transport

# --- transport streams ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 168, 169, 182, 183, 184, 16_384, 16_385, 70_000])
def test_streams_give_the_payload_back(n):
    p = transport.pad(os.urandom(n))
    s = transport.demux(transport.mux(p))
    assert s.payload == p and len(p) % 64 == 0 and len(p) > 0
    assert s.sync_errors == s.table_errors == s.continuity_errors == 0
    assert s.programs == {1: 0x100} and s.streams == {0x101: 6}


@given(st.binary(min_size=1, max_size=900), st.integers(20, 300), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_any_unit_size(data, unit, group):
    s = transport.demux(transport.mux(data, unit=unit, group=group))
    assert s.payload == data and s.continuity_errors == 0
    assert [u[0] for u in s.units] == [(k + 1) * transport.TICKS for k in range(len(s.units))]
    assert s.clocks == {0x101: [k * transport.TICKS * 300 for k in range(len(s.units))]}
    assert [u[2] for u in s.units] == [k % group == 0 for k in range(len(s.units))]


def test_faults_are_counted():
    media = transport.mux(os.urandom(5_000))
    lost = media[: 188 * 6] + media[188 * 7 :]
    assert transport.demux(lost).continuity_errors == 1
    twice = media[: 188 * 7] + media[188 * 6 : 188 * 7] + media[188 * 7 :]
    assert transport.demux(twice).continuity_errors == 0 and transport.demux(twice).payload == transport.demux(media).payload
    broken = bytearray(media)
    broken[188 * 1 + 12] ^= 1
    assert transport.demux(bytes(broken)).table_errors == 1
    broken[188 * 4] = 0
    assert transport.demux(bytes(broken)).sync_errors == 1


@pytest.mark.parametrize("n", [1, 15, 16, 17, 32])
def test_no_loss_is_silent(n):
    media = transport.mux(os.urandom(30_000))
    s = transport.demux(media[: 188 * 20] + media[188 * (20 + n) :])
    assert s.continuity_errors == (n % 16 > 0) and s.length_errors == 1


def test_sections_span_packets_and_share_them():
    """A map of 40 streams takes two packets; a second section begins where the first ends."""
    body = (0xE000 | 0x101).to_bytes(2, "big") + b"\xf0\0" + b"".join(b"\x06" + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\0" for k in range(40))
    other = (0xE000 | 0x101).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | 0x101).to_bytes(2, "big") + b"\xf0\0"
    first, second = transport.section(2, 1, body), transport.section(2, 1, other)
    cut = 183
    head = lambda counter, start: bytes([0x47]) + ((0x4000 if start else 0) | 0x100).to_bytes(2, "big") + bytes([0x10 | counter])
    one = head(0, True) + b"\0" + first[:cut]
    rest = first[cut:]
    two = (head(1, True) + bytes([len(rest)]) + rest + second).ljust(188, b"\xff")
    media = transport.mux(os.urandom(500))
    plain = transport.demux(media)
    s = transport.demux(media[:188] + one + two + media[188 * 2 :])
    assert set(s.streams) == {0x101} | {0x200 + k for k in range(40)} and s.table_errors == 0 and s.payload == plain.payload
    assert transport.demux(media[:188] + one + media[188 * 2 :]).table_errors == 1
    assert transport.demux(b"no stream at all").units == [] and transport.demux(b"").packets == 0


@given(st.binary(max_size=700))
@settings(max_examples=100, deadline=None)
def test_foreign_bytes_do_not_fail(data):
    media = bytearray(transport.mux(bytes(1_000)))
    media[100 : 100 + len(data)] = data
    transport.demux(bytes(media)), transport.demux(data), transport.demux((b"\x47" + data) * 40)


def test_rows_of_null_and_long_texts():
    each = transport.media_rows()
    (null,), (empty,) = each(1, None), each(1, "")
    assert list(null) == list(empty) and null[1:3] == (0, 64) and null[3] == hashlib.sha256(bytes(64)).hexdigest()
    (row,) = each(2, "é" * 100_000)
    assert row[1:3] == (200_000, 200_000) and row[4] == zlib.crc32(("é" * 100_000).encode()[-64:])


# --- templates -----------------------------------------------------------------------------------------------


def plain(messages):
    turns = "".join(f"{m['role'] or ''}\n{m['text'] or ''}\n" for m in messages)
    learnt = "".join(m["text"] or "" for m in messages if m["role"] == "assistant")
    return len(messages), hashlib.sha256(turns.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


message = st.fixed_dictionaries({"role": st.sampled_from(["user", "assistant", "system", None, "a]b"]), "text": st.one_of(st.none(), st.text(alphabet="a<>/s[]\\INST\n é", max_size=30))})


@given(st.lists(message, max_size=6))
@settings(max_examples=150, deadline=None)
def test_conversations_come_back(messages):
    t = templates.compile_template(templates.INSTRUCT)
    got = templates.digest(t, messages)
    assert got[:4] == plain(messages)
    text, spans = t.render(messages=messages)
    assert got[4] == len(text)
    assert "".join(templates.unescape(text[a:b]) for a, b in spans) == "".join(m["text"] or "" for m in messages if m["role"] == "assistant")


def test_control_strings_never_stand_in_texts():
    assert not any(c in templates.escape("</s>[INST] ok [/INST]") for c in "<[]")
    assert templates.unescape(templates.escape("\\l</s>\\\\")) == "\\l</s>\\\\"


def test_folding_and_statements():
    t = templates.compile_template("{% if 1 + 1 == 2 %}b{{ 'x' * 3 }}{% else %}c{% endif %}{% for i in xs %}{{ loop.index }}{{ '' if loop.last else ',' }}{% endfor %}")
    assert t.tree[0] == templates.Print(templates.Const("bxxx")) and t.render(xs=[4, 5])[0] == "bxxx1,2"
    assert templates.compile_template("{% set a = 2 %}{{ a * 3 ~ 'k' | upper }}{# no #}").render()[0] == "6K"
    assert templates.compile_template("{{ x.a['b'] if x else 'none' }}").render(x={"a": {"b": 1}})[0] == "1"


@pytest.mark.parametrize("source", ["{{ a. }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ a | open }}", "{{ __import__('os') }}", "{% exec %}", "{{ x.__class__ }}", "{{ 'a }}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(source)


@pytest.mark.parametrize(
    "source",
    [
        "{{ 'x' * 9000000000 }}", "{{ 300000000 * 'x' }}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{{ " + "[" * 5000 + " }}", "{{ 1 + 'a' }}", "{{ - 'a' }}", "{{ none | length }}",
        "{% if a %}" * 100 + "{% endif %}" * 100, "{% if a %}1" + "{% elif b %}2" * 200 + "{% endif %}", "{% for a in m %}" * 9 + "{% endfor %}" * 9, "{{ " + "9" * 400 + " }}",
        "{{ 1" + " * 9999999999" * 100 + " }}", "{% set a = 'aaaaaaaaaaaaaaaa' %}" + "{% set a = a ~ a %}" * 40 + "{{ a | length }}", "{% for x in 5 %}{% endfor %}", "x" * 300_000, "{{ " + "not " * 300 + "1 }}",
    ],
)
def test_limits_of_the_sandbox(source):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(source).render(m=[1])


def test_constants_go_through_set_and_neighbours_merge():
    tree = templates.compile_template(templates.INSTRUCT).tree
    loop = tree[-1]
    assert loop.body[0] == templates.Print(templates.Const("<s>[")) and loop.body[-1] == templates.Print(templates.Const("</s>\n"))
    assert templates.compile_template("a{% if 1 %}b{% endif %}c{{ 'd' }}").tree == (templates.Print(templates.Const("abcd")),)
    t = templates.compile_template("{% set a = 'q' %}{% if c %}{% set a = 'r' %}{% endif %}{{ a }}{% for x in 'xy' %}{{ a }}{% set a = x %}{{ a }}{% endfor %}{{ a }}")
    assert [t.render(c=c)[0] for c in (0, 1)] == ["qqxqyq", "rrxryr"]
    # A folded constant is short: a long one is made when it is rendered.
    t = templates.compile_template("{{ 'x' * 100000 }}")
    assert not isinstance(t.tree[0].expr, templates.Const) and t.render()[0] == "x" * 100_000


def test_only_mappings_are_read():
    assert templates.compile_template("{{ x.upper }}{{ x['upper'] }}").render(x="s")[0] == ""


# --- packing -------------------------------------------------------------------------------------------------


@given(st.text(alphabet=st.characters(min_codepoint=0, max_codepoint=0x2FF), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(text):
    e = packing.encoder(packing.VOCABULARY)
    assert e(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_in_texts():
    e = packing.encoder(packing.VOCABULARY)
    text = "a <|endoftext|> b"
    assert e(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_bins_hold_everything(lengths):
    n = np.array(lengths, np.int64)
    number, offset = packing.pack(n, 40)
    for k in set(number.tolist()):
        mine = sorted((offset[i], n[i]) for i in np.flatnonzero(number == k))
        ends = np.cumsum([x for _, x in mine])
        assert ends[-1] <= 40 and [a for a, _ in mine] == [0, *ends[:-1]]
    assert len(set(number.tolist())) <= len(packing.best_fit(n, 40))


def test_local_search_beats_best_fit():
    # Best fit in decreasing order needs three bins of 12 here; two hold all of it.
    n = np.array([6, 4, 4, 3, 3, 2, 2], np.int64)
    assert len(set(packing.pack(n, 12)[0].tolist())) == 2
    assert packing.local_search([[7], [6, 3], [5, 2]], 12) in ([[7, 5], [6, 3, 2]], [[7, 3, 2], [6, 5]], [[6, 5], [7, 3, 2]]) or len(packing.local_search([[7], [6, 3], [5, 2]], 12)) == 2


# --- edits ---------------------------------------------------------------------------------------------------


def print_of(text):
    return edits.fingerprint(edits.codes_of(text))


def slow_walk(text):
    table, t, out = edits.walks(), 0, []
    for c in edits.classes(edits.codes_of(text)):
        out.append(t)
        t += table[c][t % edits.PERIOD] - t % edits.PERIOD
    return [*out, t]


def test_walks_follow_their_definition():
    text = "the quick brown fox é " * 4_000
    assert edits.walk(edits.codes_of(text)).tolist() == slow_walk(text)
    assert edits.walk(edits.codes_of("")).tolist() == [0]


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3_000))
    near = base[:1500] + "#" + base[1501:]
    half = base[:1500] + base[:1500][::-1]
    assert edits.likeness(print_of(base), print_of(base)) == 1
    assert edits.likeness(print_of(base), print_of(near)) > 0.9
    assert 0.25 < edits.likeness(print_of(base), print_of(half)) < 0.75
    assert edits.likeness(print_of(base), print_of("z" * 10)) == 0
    assert edits.likeness(print_of(""), print_of("")) == 1
    p = print_of(base)
    assert edits.read(edits.spelt(p)) == p


@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b, most):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert edits.edit_distance(a, b, most) == min(d[-1][-1], most + 1)


def edited(rng, text, share):
    b = list(text)
    for _ in range(max(1, int(share * len(text) * 0.98))):
        k, what = rng.randrange(len(b)), rng.random()
        if what < 0.34:
            b.insert(k, rng.choice("abcdefghijklmnop "))
        elif what < 0.67:
            del b[k]
        else:
            b[k] = rng.choice("abcdefghijklmnop ")
    return "".join(b)


def test_bands_and_verification_find_edited_texts():
    """Recall of candidates among texts within the linked share of edits, by exact distance."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 500))) for _ in range(150)]
    for share in (0.01, 0.03, 0.05):
        got = 0
        for t in texts:
            u = edited(rng, t, share)
            exact = edits.edit_distance(t, u, 10**6)
            assert exact <= 0.05 * max(len(t), len(u))
            candidate, n = edits.verified(print_of(t), print_of(u), t, u)
            got += candidate
            assert n == (exact if candidate else None)
        assert got >= 0.9 * len(texts)
    other = [edits.verified(print_of(a), print_of(b), a, b) for a, b in zip(texts, texts[1:], strict=False)]
    assert all(n is None for _, n in other) and sum(c for c, _ in other) <= 5
    assert edits.verified(print_of(""), print_of(""), "", "") == (True, 0)


@given(st.text("ab", min_size=60, max_size=200), st.integers(0, 12), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_edit_distance_of_longer_texts(a, n, rng):
    b = list(a)
    for _ in range(n):
        k = rng.randrange(len(b))
        b[k : k + rng.randrange(2)] = rng.choice(["a", "b", ""])
    b = "".join(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    for most in (0, 3, 10, 400):
        assert edits.edit_distance(a, b, most) == min(row[-1], most + 1)


# --- licenses ------------------------------------------------------------------------------------------------


def test_templates_are_found_with_spans():
    ix = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS)
    for name, body in licenses.TEMPLATES.items():
        text = f"Some words é first.\n{body}\nand words after the end"
        got = licenses.scan(ix, text)
        assert [m["license"] for m in got] == [name] and got[0]["coverage"] == 1
        assert text[got[0]["start"] : got[0]["end"]].startswith(body[:12])


def test_changed_words_lower_the_coverage():
    ix = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS)
    body = licenses.TEMPLATES["MIT"].replace("merge", "fuse").replace("sublicense, ", "")
    (m,) = licenses.scan(ix, body)
    assert m["license"] == "MIT" and 0.97 < m["coverage"] < 1
    assert licenses.scan(ix, "") == [] and licenses.scan(ix, "nothing of the kind under the sun") == []


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith("notice")])
@pytest.mark.parametrize("between", ["\n", "\nand\n", "\nmore words stand here\n"])
def test_repeated_notices_are_all_found(name, between):
    ix, body = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS), licenses.TEMPLATES[name]
    last = [m.end() for m in licenses.WORD.finditer(body.lower())][-1]
    for n in (2, 3, 7):
        got = licenses.scan(ix, between.join([body] * n))
        step = len(body) + len(between)
        assert [(m["license"], m["coverage"], m["start"], m["end"]) for m in got] == [(name, 1, k * step, k * step + last) for k in range(n)]


def test_different_notices_close_together():
    ix = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS)
    names = ["MIT-notice", "CC-BY-NC-4.0-notice", "MIT-notice", "Apache-2.0-notice", "MIT-notice"]
    assert [m["license"] for m in licenses.scan(ix, "\n".join(licenses.TEMPLATES[n] for n in names))] == names


def test_whole_licenses_end_where_they_end():
    ix = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS)
    ends = {"ISC": "PERFORMANCE OF THIS SOFTWARE.", "BSD-2-Clause": "POSSIBILITY OF SUCH DAMAGE.", "BSD-3-Clause": "POSSIBILITY OF SUCH DAMAGE.", "GPL-3.0-header": "https://www.gnu.org/licenses/>."}
    for name, end in ends.items():
        body = licenses.TEMPLATES[name]
        assert body.endswith(end)
        numbered = body.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither the name", "3. Neither the name")
        (m,) = licenses.scan(ix, "Copyright (c) 2020, A. Person\n\n" + numbered + "\n\nint main")
        assert m["license"] == name and m["coverage"] == 1 and m["end"] == 31 + len(numbered.rstrip(".>/"))
    isc = licenses.TEMPLATES["ISC"]
    assert licenses.scan(ix, isc[: isc.index(" IN NO EVENT")]) == []
    assert licenses.scan(ix, licenses.BSD) == []


NEAR_MISSES = [
    "Released under the BSD License.", "Released under the ISC License.", "Released under the MIT-0 License.", "Released under the X11 License.", "Released under the MIT or any License.",
    "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 3.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY 4.0.",
    "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the Eclipse Public License, Version 2.0.", "Licensed under the Apache License, Version 1.1.",
    "Licensed under the Educational Community License, Version 2.0.", "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    licenses.TEMPLATES["MPL-2.0-notice"].replace("v. 2.0", "v. 1.1"), licenses.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
    licenses.TEMPLATES["GPL-3.0-header"].replace("GNU General Public", "GNU Lesser General Public"), licenses.TEMPLATES["Apache-2.0-header"].replace("Apache License, Version 2.0", "Elastic License, Version 2.0"),
    licenses.TEMPLATES["MIT"].replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
]


@pytest.mark.parametrize("text", NEAR_MISSES)
def test_other_licenses_are_not_taken_for_known_ones(text):
    ix = licenses.Index(licenses.TEMPLATES, keys=licenses.KEYS)
    assert licenses.scan(ix, f"Words before it. {text} And words after it.") == []
    body = licenses.TEMPLATES["MIT-notice"]
    assert [m["license"] for m in licenses.scan(ix, f"{text}\n{body}")] == ["MIT-notice"]


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=20))
@settings(max_examples=150, deadline=None)
def test_alignment_equals_full_dynamic_programming(template, words):
    best = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template, 1):
        for j, b in enumerate(words, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (a == b))
    n, first, last = licenses.align(template, words, 0, band=40)
    assert n == best[-1][-1]
    if n:
        assert words[first] in template and words[last] in template and n <= last - first + 1


def test_ties_go_to_the_first_template():
    ix = licenses.Index({"x": "one two three four five six", "y": "one two three four five six"})
    (m,) = licenses.scan(ix, "and one two three four five six")
    assert m["license"] == "x"


# --- hard bins -----------------------------------------------------------------------------------------------


def test_gap_of_the_search_on_hard_bins():
    """Triplets that fill bins exactly: the search ends early, within a tenth of the bound and below plain best fit."""
    for size in (60, 300):
        rng, lengths = random.Random(8), []
        for _ in range(size):
            a, b = rng.randrange(510, 760), rng.randrange(510, 760)
            lengths += [a, b, 2048 - a - b]
        n = np.array(lengths, np.int64)
        assert size <= len(set(packing.pack(n)[0].tolist())) < min(1.1 * size, len(packing.best_fit(n, 2048)))
