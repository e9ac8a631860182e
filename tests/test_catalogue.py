import random

import pytest
from pyspark.sql import functions as F

from lithos.functions import intervals as iv
from lithos.functions import names as fn
from lithos.operators import placement, records, selection
from lithos.operators.dedup import union_ignoring_case
from lithos.plans import catalog
from lithos.sources.files import decoded, read_trees, routed
from lithos.operators.skew import to_group, with_group
from lithos.sources.settings import read_favourites, read_settings, toggled, write_favourites, write_settings
from lithos.streaming import incremental
from lithos.sources import samples as a


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fn.normal_name(lit("  Foo\t  BAR ")) ) == "foo bar"
    assert one(spark, fn.version_number(lit("Version 3.25; x"))) == 3.25
    assert one(spark, fn.version_number(lit("none"))) == 0.0
    assert [one(spark, fn.format_priority(lit(x))) for x in (".OTF", "ttf", "woff2", "woff", "eot", "zip")] == [5, 4, 3, 2, 1, 0]
    assert [one(spark, fn.sorting_letter(lit(x))) for x in ("école", "Zed", "9", "", "ß", "Ñu")] == ["E", "Z", "#", "#", "#", "N"]
    assert one(spark, fn.path_component(lit('a<b>:"c. . '))) == "a-b---c"
    assert one(spark, fn.path_component(lit("..."))) == "-"
    assert one(spark, fn.vault_path(lit("My_Font"), lit("Bold"), lit(""), lit(3), lit("ttf"), lit(255))) == "M/My_Font/My-Font_Bold_v0_g3_c000000FF.ttf"
    assert [one(spark, fn.human_size(lit(n).cast("bigint"))) for n in (5, 1024, 1536, 15 * 1024**3)] == ["5B", "1KB", "1.5KB", "15GB"]
    assert [one(spark, fn.style_weight(lit(x))) for x in ("ExtraBold", "DemiBold", "Heavy", "Bold", "UltraLight", "Regular")] == [800, 600, 900, 700, 200, 400]
    assert one(spark, fn.marker_crc(lit("x_y.fv0000ABCD.ttf"))) == 0xABCD
    assert one(spark, fn.codepoints(lit("aé😀"))) == [97, 233, 0x1F600]
    assert [one(spark, fn.glyph_label(lit(c).cast("int"), lit(9))) for c in (65, 10, None)] == ["A", "U+000A", "#9"]
    assert one(spark, union_ignoring_case(F.array(lit("A"), lit("b")), F.array(lit("a"), lit("C")))) == ["A", "b", "C"]
    assert one(spark, fn.display_name(lit(""), lit(""), lit("PS"))) == "PS"


def test_licence_order(spark):
    c = lambda t, b: one(spark, fn.licence_class(F.lit(t), F.lit(None).cast("string"), F.lit(""), F.lit(b)))
    assert [c("GPL", 2), c("x", 2), c("eula", 0), c("", 0)] == ["Free", "Paid", "Paid", "Unknown"]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 5, 6), (1, 1, 4), (1, 8, 8), (1, 8, 8), (1, 10, 30), (1, 12, 13), (2, 7, 7)], "id int, start int, end int")
    assert sorted(map(tuple, iv.merge(df, ["id"]).collect())) == [(1, 1, 6), (1, 8, 8), (1, 10, 30), (2, 7, 7)]
    cover = iv.block_coverage(spark.createDataFrame([(1, 0x70, 0x90)], "id int, start int, end int"), iv.blocks(spark), ["id"])
    got = {r["block"]: r["present"] for r in cover.collect()}
    assert got["Basic Latin"] == 16 and got["Latin-1 Supplement"] == 17 and got["Thai"] == 0 and len(got) == len(iv.BLOCKS)
    lines = spark.createDataFrame([("0000..007F; Basic Latin",), ("# note",)], "value string")
    assert iv.blocks_from(lines).collect()[0]["block_end"] == 127
    grid = iv.grid(spark.createDataFrame([(1, c) for c in range(18)], "id int, cp int"), ["id"], "cp").orderBy("row_no").collect()
    assert grid[1]["cells"] == [16, 17] + [-1] * 14


def test_blocks_of_all_scripts(spark):
    """The list is whole, and texts beyond Latin get their own blocks."""
    assert len(iv.BLOCKS) == 256 and all(a <= b for a, b, _ in iv.BLOCKS) and all(p[1] < q[0] for p, q in zip(iv.BLOCKS, iv.BLOCKS[1:], strict=False))
    texts = {"Bengali": "\u0995\u0996", "Tamil": "\u0b95", "Bopomofo": "\u3105", "CJK Unified Ideographs Extension A": "\u3400", "Block Elements": "\u2588", "Supplemental Symbols and Pictographs": "\U0001f923"}
    spans = spark.createDataFrame([(k, ord(c), ord(c)) for k, t in texts.items() for c in t], "id string, start int, end int")
    cover = iv.block_coverage(spans, iv.blocks(spark), ["id"])
    assert {(r["id"], r["block"], r["present"]) for r in cover.filter("present > 0").collect()} == {(k, k, len(t)) for k, t in texts.items()}
    assert {(r["id"], r["block"]) for r in iv.first_block(cover, ["id"]).collect()} == {(k, k) for k in texts}


def sequential(rows):
    """The rule as a loop over candidates against a growing kept set."""
    key = lambda r: (r["prio"], r["version"], r["glyphs"], r["coverage_n"], r["metadata"], -r["crc32"])
    kept = [r for r in rows if r["is_existing"]]
    taken = []
    for c in sorted((r for r in rows if not r["is_existing"]), key=lambda r: (*[-x for x in key(r)], r["path"])):
        best = max(kept, key=key, default=None)
        low = best is not None and c["prio"] < best["prio"]
        if best is None or key(c) > key(best) or low and (any(c[k] > best[k] for k in ("version", "glyphs", "coverage_n", "metadata")) or c["is_variable"] and not any(k["is_variable"] for k in kept)):
            kept.append(c)
            taken.append(c["path"])
    return sorted(taken)


def test_additive_selection_equals_the_loop(spark):
    r = random.Random(1)
    rows = []
    for g in range(400):
        for k in range(r.randint(1, 7)):
            rows.append((g, r.random() < 0.3, r.randint(1, 5), float(r.randint(1, 3)), r.randint(1, 3), r.randint(1, 3), r.randint(1, 3), r.random() < 0.3, r.randint(1, 50), f"{g}-{k}"))
    names = "g is_existing prio version glyphs coverage_n metadata is_variable crc32 path".split()
    df = spark.createDataFrame(rows, "g int, is_existing boolean, prio int, version double, glyphs int, coverage_n int, metadata int, is_variable boolean, crc32 int, path string")
    got = {}
    for x in selection.additive_selection(df, ["g"]).filter("kept and not is_existing").collect():
        got.setdefault(x["g"], []).append(x["path"])
    for g in range(400):
        own = [dict(zip(names, x, strict=True)) for x in rows if x[0] == g]
        assert sorted(got.get(g, [])) == sequential(own), own


def one_after_the_other(rows):
    """Names given in order against the set of those used so far."""
    used, out = set(), {}
    for base, suffix, order in sorted(rows, key=lambda r: r[2]):
        stem, dot, ext = base.rpartition(".") if "." in base else (base, "", "")
        names = (f"{stem}{x}{dot}{ext}" for k in range(10**6) for x in ["" if k == 0 else suffix if k == 1 else f"{suffix}_{k}"])
        out[order] = next(n for n in names if n.upper() not in used)
        used.add(out[order].upper())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_collisions_equal_the_loop(spark, seed):
    """Few names, so that suffixed ones equal other files' base names; one name is shared by many."""
    r = random.Random(seed)
    rows = [("".join(r.choice(["a", "A", "_x", "_2"]) for _ in range(r.randint(1, 3))) + r.choice([".otf", ".otf", ""]), r.choice(["_x", "_2", "_x_2"]), k) for k in range(120)]
    rows += [("hot.otf", f"_c{k % 50}", 1000 + k) for k in range(200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "base string, sfx string, ord int")
    got = {x["ord"]: x["target"] for x in placement.resolve_collisions(df, "base", F.col("sfx"), "ord").collect()}
    assert got == one_after_the_other(rows)
    assert len({t.upper() for t in got.values()}) == len(rows)


def test_collisions(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2), ("a", 3), ("b", 4), ("a_x", 5), ("n.otf", 6), ("N.otf", 7)], "base string, ord int")
    got = [r["target"] for r in placement.resolve_collisions(df, "base", F.lit("_x"), "ord").orderBy("ord").collect()]
    assert got == ["a", "A_x", "a_x_2", "b", "a_x_x", "n.otf", "N_x.otf"]


def test_joins_of_hot_groups(spark):
    rows = spark.createDataFrame([(k % 3 // 2, k) for k in range(300)], "g int, id int")
    got = with_group(rows, ["g"], F.col("id"), {"lo": ("min", "id"), "hi": ("max", "id"), "s": ("sum", "id")})
    assert {(r["g"], r["lo"], r["hi"], r["s"]) for r in got.collect()} == {(0, 0, 298, sum(k for k in range(300) if k % 3 < 2)), (1, 2, 299, sum(range(2, 300, 3)))} and got.count() == 300
    groups = spark.createDataFrame([(1, "x"), (7, "y")], "g int, name string")
    assert {how: to_group(rows, groups, ["g"], F.col("id"), how).count() for how in ("inner", "left", "left_anti")} == {"inner": 100, "left": 300, "left_anti": 200}


def test_in_row_points(spark):
    points = F.array(*[F.lit(x) for x in (5, 3, 4, 9, 4)])
    assert [tuple(x) for x in one(spark, iv.runs_of(points))] == [(3, 5), (9, 9)]
    assert one(spark, iv.rows_of(F.sequence(F.lit(1), F.lit(18))))[1] == [17, 18] + [-1] * 14
    assert one(spark, iv.rows_of(F.array().cast("array<int>"))) == [] and one(spark, iv.runs_of(F.array().cast("array<int>"))) == []
    counts = spark.range(1).select("id", iv.block_counts(F.array(*[F.lit(x) for x in (0x41, 0x995, 0x42, 0x41, 0x2FE0, 0x10FFFF)])).alias("c"))
    rows = iv.presence(counts, "c", ["id"]).collect()
    assert len(rows) == 256 and {x["block"]: x["present"] for x in rows if x["present"]} == {"Basic Latin": 2, "Bengali": 1, "Supplementary Private Use Area-B": 1}
    none = iv.block_counts(F.array().cast("array<int>"))
    assert counts.select(iv.first_of(F.col("c")), iv.first_of(none)).first()[:] == ("Basic Latin", "Basic Latin")
    assert one(spark, iv.first_of(iv.block_counts(F.array(F.lit(0x995), F.lit(0x2FE0))))) == "Bengali"


def test_blocks_equal_the_platforms(spark):
    """Against the block table of the Java platform, by name where both have the name."""
    block = spark.sparkContext._jvm.java.lang.Character.UnicodeBlock
    plain = lambda s: "".join(c for c in s.upper() if c.isalnum())
    same = 0
    for a, b, name in iv.BLOCKS:
        found = [block.of(a), block.of(b)]
        if found[0] is not None and found[0].equals(found[1]) and plain(found[0].toString()) == plain(name):
            same += 1
            assert a == 0 or block.of(a - 1) is None or not block.of(a - 1).equals(found[0])
            assert b == 0x10FFFF or block.of(b + 1) is None or not block.of(b + 1).equals(found[0])
    assert same >= 240


def test_sorting_letter_sees_marks_of_any_number(spark):
    assert [one(spark, fn.sorting_letter(F.lit(x))) for x in ("\u0301" * 50 + "Éa", "\u0301" * 50, "ż", "日", None, "ſ")] == ["E", "#", "Z", "#", "#", "S"]


def test_publishing_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    entries = lambda n: spark.createDataFrame([(f"n{k}", "", "") for k in range(n)], "display_name string, typo_subfamily string, style string")
    seen = lambda: catalog.load(spark, root).count() if catalog.load(spark, root) is not None else None
    catalog.write_generation(entries(1), root)  # dies before the first pointer
    assert seen() is None
    catalog.publish(entries(2), root)
    catalog.write_generation(entries(3), root)  # dies before the pointer
    assert seen() == 2
    real = catalog._pointers
    monkeypatch.setattr(catalog, "_pointers", lambda *a: (_ for _ in ()).throw(OSError("dies with the draft written")))
    with pytest.raises(OSError):
        catalog.publish(entries(4), root)
    monkeypatch.setattr(catalog, "_pointers", real)
    assert seen() == 2
    (tmp_path / "c" / f"{catalog.POINTER}{99:012d}").write_text("")  # an empty pointer counts for nothing
    assert seen() == 2
    for n in range(5, 12):
        catalog.publish(entries(n), root)
        assert seen() == n
    assert len(real(spark, root)) <= catalog.KEPT + 1
    files = sorted((tmp_path / "c" / (tmp_path / "c" / f"{catalog.POINTER}{106:012d}").read_text()).glob("part-*"))
    names = [r["display_name"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert names == sorted(names)


def test_copies_and_repairs_are_carried_out(spark, tmp_path):
    put = lambda at, raw: ((tmp_path / at).parent.mkdir(parents=True, exist_ok=True), (tmp_path / at).write_bytes(raw))
    put("a", b"one"), put("b", b"one"), put("c", b"two"), put("out/b", b"one"), put("out/c", b"xxx")
    plan = spark.createDataFrame([(str(tmp_path / k), str(tmp_path / "out" / k)) for k in "abc"], "src string, dst string")
    assert {r["src"][-1]: r["outcome"] for r in catalog.copy_files(plan).collect()} == {"a": "copied", "b": "present", "c": "other file in the way"}
    vault = tmp_path / "v"
    put("v/x/1.otf", b"1"), put("v/x/2.otf", b"2"), put("v/y/3.otf", b"1"), put("v/z/4.otf", b"4"), put("v/z/busy.otf", b"?")
    rows = [("x/1.otf", "move", "x/2.otf"), ("x/2.otf", "move", "x/1.otf"), ("y/3.otf", "delete", ""), ("z/4.otf", "move", "z/busy.otf"), ("z/busy.otf", "keep", "z/busy.otf")]
    repair = spark.createDataFrame([(str(vault / p), act, t) for p, act, t in rows], "path string, action string, target string")
    got = {r["path"].rpartition("/v/")[2]: r["outcome"] for r in catalog.apply_repair(repair, str(vault), str(tmp_path / "staging")).collect()}
    assert got == {"x/1.otf": "moved", "x/2.otf": "moved", "y/3.otf": "deleted", "z/4.otf": "failed: the target is taken", "z/busy.otf": "kept"}
    assert ((vault / "x/1.otf").read_bytes(), (vault / "x/2.otf").read_bytes(), (vault / "z/4.otf").read_bytes()) == (b"2", b"1", b"4") and not (vault / "y").exists()


def test_settings(spark, tmp_path):
    write_settings(spark, {"vault": "/v", "sort": "1"}, str(tmp_path / "s"))
    assert read_settings(spark, str(tmp_path / "s")) == {"vault": "/v", "user_folder": "", "sort": "1", "theme": ""}


def test_session_name_ignores_order():
    assert incremental.session_name(["b", "a"], "t") == incremental.session_name(["a", "b"], "t") != incremental.session_name(["a"], "t")


def test_records(spark):
    names = spark.createDataFrame([("uni0041",), ("b.alt",), ("zzz",), ("u1F600",)], "n string")
    listed = spark.createDataFrame([("b", 98)], "glyph_name string, codepoint int")
    assert {r["n"]: r["codepoint"] for r in records.name_to_codepoint(names, listed, "n").collect()} == {"uni0041": 65, "b.alt": 98, "zzz": -1, "u1F600": 0x1F600}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / ".h").mkdir(parents=True)
    old = a.sfnt(a.tables(names=[*a.NAMES[:2], (3, 1, 0x409, 5, "Version 1.0")]))
    for name, raw in {"b.TTF": a.sfnt(), "copy.ttf": a.sfnt(), "._c.ttf": b"x", "_d.ttf": old, ".h/e.woff": a.woff(), "bad.ttf": b"nonsense nonsense", "note.txt": b"x"}.items():
        (root / name).write_bytes(raw)
    return root


def test_listing_keeps_hidden_files(spark, tree):
    rows = routed(read_trees(spark, [str(tree), str(tree / "absent")])).collect()
    assert {(r["path"].rpartition("/")[2], r["route"]) for r in rows} == {
        ("b.TTF", "asset"), ("copy.ttf", "asset"), ("._c.ttf", "sidecar"), ("_d.ttf", "asset"), ("e.woff", "asset"), ("bad.ttf", "asset"), ("note.txt", "ignore"), ("absent", "error"),
    }


def test_listing_is_planned_by_folders_and_shares(tree, monkeypatch, tmp_path):
    """Any number of parts lists every file once; a link to a folder is not followed."""
    from lithos.sources import files as f

    for k in range(40):
        (tree / "flat").mkdir(exist_ok=True)
        (tree / "flat" / f"{k}.ttf").write_bytes(b"x")
    (tree / "deep" / "er").mkdir(parents=True)
    (tree / "deep" / "er" / "z.otf").write_bytes(b"x")
    (tree / "link").symlink_to(tree / "flat")
    want = sorted(str(p) for p in tree.rglob("*") if p.is_file())
    for parts, share in ((1, 10_000), (3, 10_000), (256, 7), (256, 10_000)):
        monkeypatch.setattr(f, "PARTS", parts)
        monkeypatch.setattr(f, "SHARE", share)
        reader = f.TreeReader([f"file://{tree}", str(tmp_path / "absent")])
        planned = reader.partitions()
        got = [r for p in planned for r in reader.read(p)]
        assert sorted(p for p, _, e in got if e is None) == want and [p for p, _, e in got if e] == [str(tmp_path / "absent")]
    assert len(planned) >= 4


def test_contents_of_assets_alone_are_read(spark, tree):
    rows = read_trees(spark, [str(tree)]).collect()
    assert {r["path"].rpartition("/")[2] for r in rows if r["content"] is not None} == {"b.TTF", "copy.ttf", "_d.ttf", "e.woff", "bad.ttf"}


def test_import_accounts_for_every_file_and_is_idempotent(spark, tree, tmp_path):
    rows = decoded(routed(read_trees(spark, [str(tree)]))).cache()
    after, counts = catalog.plan_import(rows, None)
    told = {r["outcome"]: r["n"] for r in counts.collect()}
    assert sum(told.values()) == rows.count() == 5
    assert told == {"rejected": 1, "duplicate of new": 1, "duplicate of catalog": 0, "added": 1, "not the best version": 2}
    root = str(tmp_path / "catalog")
    catalog.publish(after, root)
    loaded = catalog.load(spark, root)
    first = loaded.collect()
    assert len(first) == 1 and len(first[0]["original_paths"]) == 4
    again, counts = catalog.plan_import(rows, loaded)
    assert {r["outcome"]: r["n"] for r in counts.collect()}["added"] == 0
    assert again.count() == 1
    catalog.publish(again, root)
    assert catalog.load(spark, root).count() == 1
    assert catalog.load(spark, str(tmp_path / "none")) is None
    assert catalog.heavy(catalog.load(spark, root), F.lit(True)).first()["coverage"][0]["start"] == 65
    catalog.write_rejects(rows, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), sep="\t").count() == 1
    assert [r["src"].rpartition("/")[2] for r in catalog.quarantine_plan(rows, "/q").collect()] == ["bad.ttf"]
    own, other = catalog.installed_listing(routed(read_trees(spark, [str(tree)])))
    assert own.count() == 0 and other.count() == 5
    plan = {r["path"].rpartition("/")[2]: r["action"] for r in catalog.plan_repair(rows.filter("status = 'ok'")).collect()}
    assert plan["copy.ttf"] == "delete" and plan["b.TTF"] == "move"
    moves = spark.createDataFrame([(str(tree / "b.TTF"), str(tmp_path / "out/b.ttf"))], "src string, dst string")
    assert [r["outcome"] for r in catalog.copy_files(moves).collect()] == ["copied"]
    assert [r["outcome"] for r in catalog.copy_files(moves).collect()] == ["present"]


def test_stream_takes_new_files_only(spark, tree, tmp_path):
    out, check = str(tmp_path / "rows"), str(tmp_path / "check")
    incremental.decode_stream(spark, str(tree), out, check).awaitTermination()
    n = spark.read.parquet(out).count()
    (tree / "new.ttf").write_bytes(a.sfnt(a.tables(glyphs=9)))
    incremental.decode_stream(spark, str(tree), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == n + 1
    assert incremental.resume(spark, [str(tree)], spark.read.parquet(out).select("path")).count() == 2  # the hidden ones


def test_favourites(spark, tmp_path):
    path = str(tmp_path / "fav")
    write_favourites(spark.createDataFrame([("b",), ("A",)], "family string"), path)
    fav = read_favourites(spark, path)
    assert sorted(r[0] for r in toggled(fav, spark.createDataFrame([("B",), ("c",)], "family string")).collect()) == ["A", "c"]
