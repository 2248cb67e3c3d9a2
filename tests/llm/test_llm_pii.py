"""Surrogates: coreference, format, full value spaces, and all texts against a plain scan."""

import re
import string

import regex

from srclens.llm import pii


def _run(spark, texts, fields="doc_id long, text string"):
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), fields)).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_names_keep_coreference_and_leave_nothing(spark):
    a, b, c, d, e, f, g = _run(spark, [
        "Mr. John Smith met Mr. Smith.", "Dear Mr. John A. Smith, hello", "MR. JOHN SMITH WAS", "Señora María García de la Vega y Ruiz; don Juan van Dyke's",
        "Dr. Anna Weber and Frau Anna Weber", "господин Иван Петров", "Mr.\nSmith, Prof. K. L. Smith-Jones; 5 m North"])
    given, family, again = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr\. (\w+)\.", a).groups()
    assert family == again and given in pii.GIVEN["latin"]["m"] and not {"John", "Smith"} & {given, family}
    middle = re.fullmatch(rf"Dear Mr\. {given} (\w)\. {family}, hello", b).group(1)
    assert middle != "A" and middle in string.ascii_uppercase
    assert c.startswith(f"MR. {given.upper()} {family.upper()}")
    assert re.fullmatch(r"Señora \w+ \w+ de la \w+ y \w+; don \w+ van \w+'s", d) and not re.search("María|García|Vega|Ruiz|Juan|Dyke", d)
    doctor, woman = re.fullmatch(r"Dr\. (\w+ \w+) and Frau (\w+ \w+)", e).groups()
    assert doctor == woman and doctor.split()[0] in pii.GIVEN["latin"]["f"]
    first, last = f.split()[1:]
    assert first in pii.GIVEN["cyrillic"]["m"] and first != "Иван" and last != "Петров" and regex.fullmatch(r"\p{IsCyrillic}+", last)
    assert re.fullmatch(rf"Mr\.\n{family}, Prof\. [^K]\. [^L]\. \w+; 5 m North", g) and "Jones" not in g


def test_numbers_and_addresses_keep_their_format(spark):
    a, b, c, d = _run(spark, ["+49 30 12345 and +1 (248) 555-6359 and (248) 555-6359 and +353 1 234 5678", "J.Smith@Corp.com j.smith@other.org Ann@corp.com",
                              "PASSWORD: abc123xyz db_password='s3cr3t_s3'", "..x@y.de " + "a" * 200_000])
    german, first, second, irish = re.fullmatch(r"\+49 (\d\d \d{5}) and \+1 (\(\d{3}\) \d{3}-\d{4}) and (\(\d{3}\) \d{3}-\d{4}) and \+353 (\d \d{3} \d{4})", a).groups()
    assert first == second != "(248) 555-6359" and german != "30 12345" and irish != "1 234 5678"
    one, host, local, other, ann, same = re.fullmatch(r"([A-Z]\.[A-Z][a-z]{4})@([A-Z][a-z]{3})\.com ([a-z]\.[a-z]{5})@([a-z]{5})\.org ([A-Z][a-z]{2})@([a-z]{4})\.com", b).groups()
    assert one.lower() == local != "j.smith" and host.lower() == same != "corp" and other != "other" and ann != "Ann"
    assert "abc123xyz" not in c and "s3cr3t" not in c and d.endswith("a" * 200_000) and re.match(r"\.\.[a-z]@[a-z]\.de ", d)


def test_full_spaces_end_and_stay_distinct(spark):
    letters = string.ascii_lowercase
    mails = [f"{x}@{y}.co" for x in letters for y in letters]
    names = [f"Herr {x}{y}bert Zzyzx" for x in "BCDFGHKLMN" for y in "aeiou"]
    got = _run(spark, mails + names + [f"Mr. {n} Zzyzx" for n in pii.GIVEN["latin"]["m"]])
    new = got[:len(mails)]
    assert len(set(new)) == len(mails) and not set(new) & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]+\.co", m) for m in new)
    given = [t.split()[1] for t in got[len(mails):]]
    assert len(set(given)) == len(given) and not set(given) & set(pii.GIVEN["latin"]["m"])
    assert len({t.split()[2] for t in got[len(mails):]}) == 1


def test_all_texts_against_a_plain_scan(spark, prose):
    """Text outside the mentions stays; mentions of one entity get one surrogate, different ones different."""
    got = {r.doc_id: r.text for r in pii.replace_pii(prose).collect()}
    pattern, forward, mentions = regex.compile(pii.ANY), {}, 0
    for r in prose.collect():
        found = [m.span() for m in pattern.finditer(r.text or "")]
        mentions += len(found)
        if not found:
            assert got[r.doc_id] == r.text
            continue
        ends = [0, *(e for _, e in found)]
        gaps = [r.text[e:s] for e, s in zip(ends, [*(s for s, _ in found), len(r.text)])]
        new = re.fullmatch("(.+?)".join(map(re.escape, gaps)), got[r.doc_id], re.S).groups()
        for (s, e), put in zip(found, new):
            assert forward.setdefault(r.text[s:e].lower(), put.lower()) == put.lower()
    assert mentions and len(set(forward.values())) == len(forward) and not set(forward) & set(forward.values())


def test_odd_columns_and_tables(spark, none):
    t = spark.createDataFrame([(1, None, 5, 1, "x", 9), (1, "", 5, 1, "y", 9), (2, "a@b.co", 5, 1, "z", 9), (2, "a@b.co", 5, 1, "z", 9)],
                              "rid long, text string, at int, __pii_rid int, kind string, n_entities int")
    got = sorted(pii.replace_pii(t).collect(), key=str)
    assert len(got) == 4 and [r.n_entities for r in got].count(1) == 2 and {r.text for r in got if r.rid == 1} == {None, ""}
    assert len({r.text for r in got if r.rid == 2}) == 1 and pii.replace_pii(none).count() == 0
