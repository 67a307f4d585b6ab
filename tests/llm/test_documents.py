import random

import numpy as np
from pyspark.sql import functions as F

from vellum.llm.containers import bucket_boundaries, contained, layout
from vellum.llm.leakage import holds_passage, leaked_items
from vellum.llm.sentences import mask, sentences


def split(spark, text):
    return [r["sentence"] for r in sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("sent_no").collect()]


SENTENCES = [
    ["Dr. Vovgard met Prof. K. Lee at 9.30 a.m. on p. 4.", "She studied in the U.K.", "Wait!", "eForms are accepted."],
    ["“We start at 9.00. Bring the forms.” was the only note.", "It was late (the bus had gone. Nobody minded!) when we left.", 'He wrote: "Nothing is final."', "The list is at www.a.example/index.php?id=4 now."],
    ["Im 19. Jahrhundert war das anders.", "Der 279. Jahrgang beginnt, vgl. Abschn. 2, z. B. Nr. 5, usw.", "„Wann?“, fragte sie.", "Laut Nr. 7 gilt das."],
    ["Le Pr. Lund est absent !", "« Rien n'est dit. Attendez. », lit-on ici.", "Voir vol. 2, n° 3."],
    ["EE. UU. y la U. E. firman.", "«¿Por qué no?», preguntó Ana.", "La Sra. Cre escribió: «Nada está cerrado.»", "¿Quién va?"],
    ["«Когда?» — спросила Анна.", "В 1996 г. совет решил, т. е. раз в год.", "Принесите фото и т. д.", "Готово."],
    ["「今日は休みです。明日来てください。」と書いてあった。", "なぜですか？", "比率は9.5％だ……たぶん。"],
    ["门上写着：“今天不办公。请明天再来。”", "“谁来了？”王主任问道。", "很好！"],
    ["Ο κ. Κώστας ήρθε στις 8.00 μ.μ. με φίλους.", "Τι λέει;", "«Πότε;» ρώτησε η Άννα."],
]


def test_sentences(spark):
    for want in SENTENCES:
        joiner = "" if any("。" in w for w in want) else " "
        assert split(spark, joiner.join(want)) == want
        assert split(spark, "\n\n".join(want)) == want
    assert split(spark, "A heading\n\nhard\nwrapped line one. Line\ntwo.") == ["A heading", "hard\nwrapped line one.", "Line\ntwo."]
    assert split(spark, "ในปี 2002 เป็นต้นมา ระบบ Intranet จะดี ทำไม") == ["ในปี 2002 เป็นต้นมา", "ระบบ Intranet จะดี", "ทำไม"]
    assert split(spark, "यह अच्छा है। क्या? “कुछ नहीं। रुकें।” कमरे पर लिखा था।") == ["यह अच्छा है।", "क्या?", "“कुछ नहीं। रुकें।” कमरे पर लिखा था।"]


def test_positions_are_kept_and_odd_texts(spark):
    text = "xy. " + "One 😀 two. " * 2000
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, " \n\n ", "c"), (4, "", "d"), (5, "no end", "e"), (5, "no end", "e")], "doc_id int, text string, sent_end string")
    assert df.where("text is not null").where(F.length(mask(F.col("text"))) != F.length("text")).count() == 0
    got = sentences(df).collect()
    assert all(r["sentence"] == (text if r["doc_id"] == 1 else "no end")[r["start"] : r["sent_end"]] for r in got)
    assert sum(r["doc_id"] == 1 for r in got) == 2001 and sum(r["doc_id"] == 5 for r in got) == 2
    assert sentences(df.limit(0)).count() == 0


def test_long_quotations_brackets_and_addresses_have_no_bound(spark):
    inside = " ".join(f"Part {i} was read. Nobody spoke!" for i in range(400))
    want = [f"“{inside}” was all he said.", f"It ended ({inside}) at noon.", "See www.a.example/" + "x" * 5000 + "?a=1 for more.", f"He wrote: “{inside}”", "Nothing followed."]
    assert split(spark, " ".join(want)) == want
    greek = "Τι " + "λέει " * 300 + "τώρα;"
    assert split(spark, greek + " Ναι.") == [greek, "Ναι."]


def test_time_grows_with_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "He said “no. Never” (it was late). " * n)], "doc_id int, text string")
        began = time.time()
        assert sentences(df).count() == n
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 60 * max(seconds(4_000), 0.5)


def test_seeds_meet_every_passage_of_twelve_with_two_edits():
    import itertools

    from vellum.llm.leakage import MASKS, seeds_at, variants

    item = np.random.default_rng(3).integers(1, 2**62, 12)
    own = {int(x) for m, mask in enumerate(MASKS) for v in variants(mask) for x in seeds_at(item, v, m)}
    forms = set()
    for k in range(3):
        for kinds in itertools.product("cda", repeat=k):
            for places in itertools.combinations_with_replacement(range(12), k):
                out = []
                for i in range(12):
                    here = [kind for kind, at in zip(kinds, places, strict=True) if at == i]
                    out += [-1] * here.count("a") + ([-1] if "c" in here else [] if "d" in here else [i])
                forms.add(tuple(out))
    for form in forms:
        doc = np.array([item[i] if i >= 0 else 2**62 + 7 * n for n, i in enumerate(form)], np.int64)
        assert any(int(x) in own for m, mask in enumerate(MASKS) for x in seeds_at(doc, variants(mask)[0], m)), form


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    rnd = random.Random(4)
    counts = np.array([0] + [rnd.randint(0, 5) for _ in range(11)] + [3])
    lengths = [i for i in range(1, 13) if counts[i]]

    def padding(bounds):
        return sum(counts[x] * (min(b for b in bounds if b >= x) - x) for x in lengths)

    for k in (1, 2, 3, 4):
        best = min(padding((*c, lengths[-1])) for c in combinations(lengths[:-1], k - 1))
        assert padding(bucket_boundaries(counts, k)) == best and len(bucket_boundaries(counts, k)) <= k


def test_layout_places_everything_once():
    segments, used = layout([3, 5, 9], [7, 4, 2], 10)
    room = {}
    for bound, n, parts in zip([3, 5, 9], [7, 4, 2], segments, strict=True):
        slots = set()
        for rank in range(n):
            first, each, base, slot = [s for s in parts if s[0] <= rank][-1]
            c = base + (rank - first) // each
            slots.add((c, slot + (rank - first) % each))
            room[c] = room.get(c, 0) + bound
        assert len(slots) == n
    assert max(room.values()) <= 10 and set(room) == set(range(used))


def test_contained(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(["word"] * rnd.randint(1, 60))) for i in range(300)] + [(900, "word " * 450), (901, None), (902, " \n"), (903, ""), (5, "word twice")]
    got = contained(spark.createDataFrame(docs, "doc_id int, text string"), capacity=64, buckets=8).toPandas()
    fill = got.groupby("container_id")["n_tokens"].sum()
    assert fill.max() <= 64 and fill.mean() > 0.85 * 64
    assert len(got.groupby(["container_id", "slot"])) == len(got)
    assert set(got.doc_id) == set(range(300)) | {900}
    parts = got[got.doc_id == 900].sort_values("part_no")
    assert len(parts) > 1 and list(parts.start_token) == [64 * i for i in range(len(parts))] and (got[got.doc_id != 900].groupby("doc_id").size().drop(5) == 1).all()
    assert contained(spark.createDataFrame(docs[:0], "doc_id int, text string")).count() == 0
    plain = contained(spark.createDataFrame(docs, "doc_id int, text string"), capacity=64, buckets=8, mixed=False).toPandas()
    assert len(plain) == len(got) and plain.groupby("container_id")["n_tokens"].sum().max() <= 64 and plain.container_id.nunique() >= got.container_id.nunique()
    assert len(plain.groupby(["container_id", "slot"])) == len(plain)


def test_leaks(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [rnd.choice(vocabulary) for _ in range(50)]
    noise = lambda n: ["n" + str(rnd.randrange(10_000)) for _ in range(n)]

    def edited(words):
        out = list(words)
        for k in range(5, len(out), 6):
            out[k] = "changed"
        return out

    docs = {
        1: noise(200) + item[5:17] + noise(200), 2: noise(20) + edited(item[3:45]) + noise(10), 3: noise(50) + item[10:18] + noise(50), 4: noise(300), 5: [w for k, w in enumerate(item[:24]) if k % 7 != 3],
        6: edited(item[20:32]), 7: [x for w in item[:18] for x in ((w, "added") if w == item[9] else (w,))],
    }
    df = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in docs.items()] + [(8, None), (9, ""), (1, ", ".join(docs[1]))], "doc_id int, text string")
    tests = spark.createDataFrame([(70, " ".join(item)), (71, "too short"), (72, None)], "item_id int, text string")
    assert {tuple(r) for r in leaked_items(df, tests).collect()} == {(1, 70), (2, 70), (5, 70), (6, 70), (7, 70)}
    assert leaked_items(df, tests.limit(0)).count() == 0 and leaked_items(df.limit(0), tests).count() == 0
    assert holds_passage(item, item[30:42], 12) and not holds_passage(item, item[30:38], 12)
    zh = "沉没的水渠遮住下面的长苔的铁锚而六分仪托起沉没的水渠破旧的陶窑"
    zdf = spark.createDataFrame([(1, "前言" + zh[4:26] + "后记"), (2, "前言" + zh[4:14] + "后记")], "doc_id int, text string")
    assert [tuple(r) for r in leaked_items(zdf, spark.createDataFrame([(3, zh)], "item_id int, text string")).collect()] == [(1, 3)]
