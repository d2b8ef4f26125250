import random
import re

from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions import text as fx
from datatrawl.operators import text as tx
from datatrawl.operators.authors import publisher_orgs
from datatrawl.operators.overlap import overlap_join


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts():
    rng = random.Random(7)
    alphabet = "ab1é .,!?\n\t-"
    made = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 5, 499, 500, 501, 502, 3000)]
    return made + ["x" * 2500 + " end", "-" * 3000, "- a " * 900, " " * 700 + "a" + " " * 700 + "b", "Ünï 中文。x"]


def test_tokens_against_a_plain_scan(spark):
    all_texts = texts()
    got = sorted(tuple(r) for r in tx.tokens(docs(spark, *all_texts)).collect())
    want = sorted((i, m.start(), m.end(), m.group()) for i, t in enumerate(all_texts)
                  for m in re.finditer(r"[^\W_]+", t))
    assert got == want


def test_pieces_lie_end_to_end_and_words_are_what_java_takes_for_them(spark):
    all_texts = texts() + ["a\U0001d7d8\u0378b \u2167 \u0300c", "x" * 700 + " y " * 400, None]
    blocks = fx.text_blocks(docs(spark, *all_texts), fx.WORD_BLOCKS)
    rows = sorted(fx.word_rows(blocks).collect(), key=lambda r: (r.doc_id, r.start))
    pattern = rf"({fx.WORD_PIECES})"
    plain = docs(spark, *all_texts).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)))
    want = {}
    for i, piece in plain.collect():
        want.setdefault(i, []).append(piece)
    assert {i: [r.piece for r in rows if r.doc_id == i] for i in want} == want
    for i, pieces in want.items():
        at = 0
        for r in (r for r in rows if r.doc_id == i):
            assert (r.begin, r.end) == (at, at + len(r.piece))
            assert r.piece.endswith(r.word) and r.start == r.end - len(r.word)
            assert all_texts[i][r.start:r.end] == r.word
            at = r.end


def test_words_are_cut_on_arrays(spark):
    """Only blocks are cut by an expression; each word cost several that Spark interprets."""
    plan = tx.tokens(docs(spark, "a b"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("regexp_extract_all") == 1


def plain_sentences(text):
    """Goes over the stops one by one and asks of each whether it ends the sentence."""
    out, begin, i = [], 0, 0
    while i < len(text):
        if text[i] not in ".!?":
            i += 1
            continue
        stops = i
        while i < len(text) and text[i] in ".!?":
            i += 1
        if text[stops:i] == ".":
            if i < len(text) and text[i].isalnum():
                continue
            last = re.search(r"[^\W_]*\Z", text[begin:stops]).group()
            before = text[:stops - len(last)][-1:]
            if last in fixed.ABBREVIATIONS or (len(last) == 1 and (last.isupper() or (last.isalpha() and before == "."))):
                continue
        while i < len(text) and text[i] in "\"')]":
            i += 1
        while i < len(text) and text[i] in " \t\r\n\f":
            i += 1
        out.append((begin, i, text[begin:i]))
        begin = i
    return out + ([(begin, len(text), text[begin:])] if begin < len(text) else [])


def test_sentences_against_a_plain_scan(spark):
    rng = random.Random(11)
    parts = ["Dr.", "A.", "e.g.", "word", "word.", "3.5", "No. ", "U.S.", "end!", "(so.)", "\"yes.\"", " ", " ", "\n", "...", "x.y", "I.", "al."]
    all_texts = texts() + ["".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(n)) for n in (5, 50, 3000)]
    got = sorted(tuple(r) for r in tx.sentences(docs(spark, *all_texts)).collect())
    assert got == sorted((i, *s) for i, t in enumerate(all_texts) for s in plain_sentences(t))
    one = "Dr. A. B. Smith paid 3.5 million. Mr. X (of the U.S. board) said \"No.\" Then he left."
    assert [s for _, _, s in plain_sentences(one)] == [
        "Dr. A. B. Smith paid 3.5 million. ", "Mr. X (of the U.S. board) said \"No.\" Then he left."]
    assert [r.sentence for r in tx.sentences(docs(spark, one)).orderBy("start").collect()] == [s for _, _, s in plain_sentences(one)]


def test_phrases_against_a_plain_scan(spark):
    """Phrases over block borders are found, once, and the longest wins."""
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh"]
    long_text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(4000))
    gazetteer = spark.createDataFrame(
        [("ab cd", "x"), ("ab cd ef gh", "x"), ("(gh)", "y"), ("ef, gh", "z")],
        "phrase string, major_type string")
    got = sorted((r.start, r.end, r.major_type) for r in
                 tx.gazetteer_lookup(docs(spark, long_text), gazetteer).collect())
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\w+", long_text)]
    phrases = {"ab cd": "x", "ab cd ef gh": "x", "gh": "y", "ef, gh": "z"}
    want = []
    for i, (start, _) in enumerate(tokens):
        hits = [(start, end, phrases[key]) for _, end in tokens[i:i + 4]
                if (key := re.sub(r"\s+", " ", long_text[start:end])) in phrases]
        want += hits[-1:]
    assert got == sorted(want)


def test_a_word_costs_the_same_however_long_a_phrase_is(spark):
    rng = random.Random(4)
    words = ["ab", "cd", "ef", "gh"]
    text = " ".join(rng.choice(words) for _ in range(3000)) + " " + " ".join(f"w{i}" for i in range(7)) + " ab  cd"
    long_phrase = " ".join(f"w{i}" for i in range(200))
    short = spark.createDataFrame([("ab cd", "x"), ("w2 w3 w4", "y")], "phrase string, major_type string")
    both = short.unionByName(spark.createDataFrame([(long_phrase, "z")], "phrase string, major_type string"))
    want = sorted([(m.start(), m.start() + 5, "x") for m in re.finditer("ab cd", text)]
                  + [(text.index("w2"), text.index("w5") - 1, "y"), (len(text) - 6, len(text), "x")])
    for gazetteer in (short, both):
        found = tx.gazetteer_lookup(docs(spark, text), gazetteer)
        assert sorted((r.start, r.end, r.major_type) for r in found.collect()) == want
    whole = docs(spark, "x " + " ".join(f"w{i}" for i in range(12)) + " y")
    twelve = spark.createDataFrame([(" ".join(f"w{i}" for i in range(12)), "z"), ("w1", "y")], "phrase string, major_type string")
    assert sorted((r.start, r.major_type) for r in tx.gazetteer_lookup(whole, twelve).collect()) == [(2, "z"), (5, "y")]
    assert tx.gazetteer_lookup(whole, twelve, lengths=[1]).count() == 1


def test_roots_by_rules(spark):
    forms = {"publishes": "publish", "distributing": "distribute", "created": "create", "studies": "study", "mapping": "map",
             "provided": "provide", "Producing": "produce", "boxes": "box", "classes": "class", "need": "need", "using": "using",
             "is": "is", "this": "this", "thing": "thing", "X3s": "X3s", "maps": "map", "agreed": "agreed", "string": "string"}
    tokens = spark.createDataFrame([(f,) for f in forms], "token string")
    lemmas = spark.createDataFrame([("string", "string"), ("this", "this")], "form string, root string")
    assert {r.token: r.root for r in tx.token_roots(tokens, lemmas).collect()} == forms


def test_roots_as_a_plain_loop_over_the_rules_gives_them(spark):
    def by_loop(word):
        for ending in sorted(fixed.ROOT_RULES, key=len, reverse=True):
            root = word.lower().removesuffix(ending) + fixed.ROOT_RULES[ending]
            if word.lower().endswith(ending) and len(root) >= fixed.ROOT_LETTERS and re.search("[aeiouy]", root):
                return root
        return word

    stems = ["", "a", "s", "st", "xyl", "bcd", "crea", "mapp", "Stu", "TH", "é", "a1"]
    forms = {a + b for a in stems for b in [*fixed.ROOT_RULES, "ING", "Ches", "edx"]}
    tokens = spark.createDataFrame([(f,) for f in forms], "token string")
    none = spark.createDataFrame([], "form string, root string")
    want = {f: by_loop(f) if re.fullmatch("[A-Za-z]+", f) else f for f in forms}
    assert {r.token: r.root for r in tx.token_roots(tokens, none).collect()} == want


def test_no_phrases_no_hits(spark):
    empty = spark.createDataFrame([], "phrase string, major_type string")
    assert tx.gazetteer_lookup(docs(spark, "a b"), empty).count() == 0


def test_organization_by_suffix(spark):
    rows = tx.suffix_organizations(docs(
        spark, "We met at Ohio State University, and Acme Data Inc. The Inc is no University")).collect()
    assert sorted((r.start, r.end, r.text) for r in rows) == [
        (10, 31, "Ohio State University"), (37, 50, "Acme Data Inc"), (52, 59, "The Inc")]


def test_whole_names_from_the_start_of_a_word(spark):
    rows = tx.suffix_organizations(docs(
        spark, "One Two Three Four Five Six Seven University", "eBay Inc and iPhone Maker Ltd", "X-Ray Labs Inc's heirs",
        "Inc Ltd Friends", "Big  Labs Inc")).collect()
    assert sorted((r.doc_id, r.start, r.text) for r in rows) == [
        (0, 0, "One Two Three Four Five Six Seven University"), (1, 20, "Maker Ltd"), (2, 0, "X-Ray Labs Inc"), (3, 0, "Inc Ltd"),
        (4, 5, "Labs Inc")]


def plain_names(text):
    """Names by walking over the words of each clause."""
    out = []
    word = r"[^\W_][\w&'-]*".replace(r"\w", r"[^\W_]").replace("[[^\\W_]&'-]", "(?:[^\\W_]|[&'-])")
    for clause in re.finditer(rf"{word}(?: (?:{word}|&))*", text):
        words, at = clause.group().split(" "), clause.start()
        starts = [at + sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
        ending = [next((e for e in sorted(fixed.ORGANIZATION_SUFFIXES, key=len, reverse=True)
                        if re.match(rf"{e}(?![^\W_])", w)), None) for w in words]
        kind = [e == w and e in fixed.ORGANIZATION_KINDS for e, w in zip(ending, words)]
        tailed = [e is not None and e != w for e, w in zip(ending, words)]
        capital = [w[0].isupper() for w in words]
        name_of = [0] * len(words)      # of a word: the end of the suffixed name it begins, else 0
        inside = [False] * len(words)
        k = 0
        while k < len(words):
            j, last = k, None
            while j < len(words) and capital[j]:
                if ending[j]:
                    last = j
                if tailed[j]:
                    break
                j += 1
            if last is None:
                k = max(j, k + 1)
                continue
            if last > k:
                name_of[k] = last + 1
            for x in range(k, last + 1):
                inside[x] = True
            k = last + 1
        plain = [c and not i for c, i in zip(capital, inside)]

        def plains(k):
            while k < len(words) and plain[k]:
                k += 1
            return k

        def further(k):
            """Behind "of ..." parts from word k on, or k."""
            while k < len(words) and words[k] in ("of", "for"):
                j = k + 1 + (k + 1 < len(words) and words[k + 1] == "the")
                if j < len(words) and name_of[j]:
                    k = name_of[j]
                elif plains(j) > j:
                    k = plains(j)
                    if k < len(words) and words[k] in ("and", "&") and plains(k + 1) > k + 1:
                        k = plains(k + 1)
                else:
                    break
            return k

        k = 0
        while k < len(words):
            head = k
            if plains(k) > k and plains(k) + 1 < len(words) and words[plains(k)] in ("and", "&") and name_of[plains(k) + 1]:
                head = plains(k) + 1
            end = name_of[head]
            if end:
                end = further(end) if kind[end - 1] else end
            elif kind[k] and inside[k] and further(k + 1) > k + 1:
                end = further(k + 1)
            if not end:
                k = max(plains(k), k + 1)
                continue
            last = ending[end - 1] or re.sub(r"(?:'s)?['&-]*\Z", "", words[end - 1])
            out.append((starts[k], " ".join(words[k:end - 1] + [last])))
            k = end
    return sorted(out)


def test_names_by_grammar_against_a_plain_walk(spark):
    rng = random.Random(2)
    words = ["Ohio", "State", "University", "Department", "of", "for", "the", "and", "&", "Acme", "Inc", "Inc's", "Ltd", "maps",
             "Land", "Institute", "Council's", "Sea's", "iPhone", "X-Ray"]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ", ", "  ", ". "]) for _ in range(n)) for n in [3] * 200 + [12] * 150 + [400]]
    listed = ["Department of Land and Water", "Smith and Jones Inc", "University of the Sea and Acme Data Inc", "Institute of Ohio State University"]
    rows = tx.grammar_organizations(docs(spark, *made, *listed)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.text))
        assert r.end == r.start + len(r.text)
    assert {i: sorted(v) for i, v in got.items()} == {i: n for i, t in enumerate([*made, *listed]) if (n := plain_names(t))}
    assert [got[len(made) + k] for k in range(4)] == [
        [(0, listed[0])], [(0, listed[1])], [(0, "University of the Sea"), (26, "Acme Data Inc")], [(0, listed[3])]]


def test_a_listed_phrase_heads_a_name(spark):
    gazetteer = spark.createDataFrame([("blue river", "organization"), ("river", "organization")], "phrase string, major_type string")
    rows = tx.organizations(docs(spark, "the blue river Data Institute, blue river. Data Ltd"), gazetteer).collect()
    assert sorted((r.start, r.end, r.text) for r in rows) == [
        (4, 14, "blue river"), (4, 29, "blue river Data Institute"), (9, 14, "river"), (31, 41, "blue river"), (36, 41, "river"),
        (43, 51, "Data Ltd")]


def test_overlap_against_all_pairs(spark):
    rng = random.Random(5)
    a = [(rng.randrange(3), s, s + rng.choice([0, 1, 5, 300])) for s in rng.choices(range(900), k=80)]
    b = [(rng.randrange(3), s, s + rng.choice([1, 40, 900])) for s in rng.choices(range(900), k=80)]
    left = spark.createDataFrame(a, "doc_id int, start long, `end` long")
    right = spark.createDataFrame(b, "doc_id int, b_start long, b_end long")
    got = sorted((r.doc_id, r.start, r.end, r.b_start, r.b_end)
                 for r in overlap_join(left, right, width=64).collect())
    want = sorted((d, s, e, s2, e2) for d, s, e in a for d2, s2, e2 in b
                  if d == d2 and s < e and s < e2 and s2 < e)
    assert got == want


def test_publishers_need_the_effective_root(spark):
    d = docs(spark, "Made by A B Inc. We create C D Inc maps. They publish E F Inc maps.")
    lemmas = spark.createDataFrame([("creates", "create")], "form string, root string")
    rooted = tx.token_roots(tx.tokens(d), lemmas)
    orgs = tx.suffix_organizations(d)
    sents = tx.sentences(d)
    assert {r.author for r in publisher_orgs(sents, rooted, orgs).collect()} == {"C D Inc"}
    both = publisher_orgs(sents, rooted, orgs, roots=("create", "publish")).collect()
    assert {r.author for r in both} == {"C D Inc", "E F Inc"}


def test_only_wanted_roots_are_looked_for(spark):
    forms = ["created", "Creates", "CREATING", "created", "create", "Create", "creator", "made", "mades", "plans", "planned", "plan", "is"]
    lemmas = spark.createDataFrame([("creates", "make"), ("made", "create"), ("plan", None)], "form string, root string")
    d = docs(spark, " ".join(forms))
    for wanted in (("create",), ("create", "plan", "Create"), ("make", "i"), ()):
        all_roots = tx.token_roots(tx.tokens(d), lemmas).filter(F.col("root").isin(list(wanted)))
        got = tx.token_roots(tx.tokens(d), lemmas, wanted)
        assert sorted(got.collect()) == sorted(all_roots.collect()), wanted
    assert set(fx.forms_by_rules(["plan"])) >= {"plans", "planned", "planning"}


def test_names_are_sought_in_telling_blocks_only(spark):
    """Long clauses, and texts without any mark between clauses, are cut no differently."""
    rng = random.Random(4)
    parts = ["Ohio State University", "Acme Data Inc", "land of", "& Sons Ltd", "x-ray's", "and", "the Sea"]
    made = [rng.choice([". ", ", ", " (", "\n", "-", " & "]).join(" ".join(rng.choices(parts, k=k)) for k in rng.choices([1, 2, 60], k=20))
            for _ in range(20)] + ["word " * 700 + "Acme Inc", "Inc" * 400, "- " * 900 + "Rio Bank Ltd" + " -" * 900, None]
    rows = tx.grammar_organizations(docs(spark, *made)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.text))
    assert {i: sorted(v) for i, v in got.items()} == {i: n for i, t in enumerate(made) if t and (n := plain_names(t))}
    # Before, the clauses of a whole text were cut if one name stood in it.
    blocks = fx.text_blocks(docs(spark, "Acme Inc. " + "No name in here, as it is. " * 400), tx.CLAUSE_BLOCKS)
    assert blocks.count() > 20
