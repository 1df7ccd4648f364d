"""Import resolution of the remaining ecosystems, surfaces and entrypoints."""

from pyspark.sql import functions as F

from findlake.operators import policy, resolve, surface
from findlake.plans.registry import query
from findlake.plans.tables import table

PARTS_SQL = "parts AS (SELECT p_partkey AS k, p_size AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part)"


def _parts(spark, sf_dir):
    names = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), names[0].alias("a"), names[1].alias("n"))


def _path(*pieces):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces])


A, N, K, S = (lambda: F.col("a")), (lambda: F.col("n")), (lambda: F.col("k").cast("string")), (lambda: F.col("s"))


@query(
    "alias_imports",
    f"""WITH {PARTS_SQL},
files AS (SELECT 'src/' || a || '/' || n || '/k' || k || '.ts' AS path FROM parts WHERE s % 2 = 0),
i AS (SELECT k, CASE WHEN s % 10 = 1 THEN '#' || a WHEN s % 10 = 3 THEN 'react-' || n ELSE '@app/' || a || '/' || n || '/k' || k END AS spec FROM parts)
SELECT k, spec AS specifier, CASE WHEN f.path IS NOT NULL THEN 'file' WHEN spec LIKE '@app/%' THEN 'alias-target-not-found' WHEN spec LIKE '#%' THEN 'unknown-alias' ELSE 'external' END AS outcome, f.path AS target
FROM i LEFT JOIN files f ON spec LIKE '@app/%' AND f.path = 'src/' || substr(spec, 6) || '.ts'""",
)
def alias_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    files = parts.where("s % 2 = 0").select("repo", _path("src/", A(), "/", N(), "/k", K(), ".ts").alias("path"))
    spec = F.when(S() % 10 == 1, _path("#", A())).when(S() % 10 == 3, _path("react-", N())).otherwise(_path("@app/", A(), "/", N(), "/k", K()))
    imports = parts.select("repo", _path("app/i", K(), ".ts").alias("file"), F.col("k").cast("int").alias("line"), spec.alias("specifier"), F.lit(".").alias("scope"))
    aliases = spark.createDataFrame([("r", ".", 0, "@app/*", 0, "gone/*"), ("r", ".", 0, "@app/*", 1, "./src/*"), *(("r", ".", k, f"@other{k}/*", 0, "src/*") for k in range(1, 60))], "repo string, scope string, ord int, pattern string, target_ord int, target string")
    packages = spark.createDataFrame([("r", "unused", "u")], "repo string, name string, module string")
    found = resolve.resolve_scripts(imports, files, packages, aliases)
    return found.select(F.col("line").cast("long").alias("k"), "specifier", "outcome", "target")


@query(
    "psr4_imports",
    f"""WITH {PARTS_SQL},
files AS (SELECT 'src/' || a || '/' || n || '/K' || k || '.php' AS path FROM parts WHERE s % 2 = 0 UNION SELECT 'src/' || a || '/' || n || '.php' FROM parts WHERE n = 'gear' UNION SELECT 'lib/' || n || '.php' FROM parts WHERE a = 'red' AND s > 25),
i AS (SELECT k, a, n, CASE WHEN s % 9 = 0 THEN 'Vendor\\' || a ELSE 'App\\' || a || '\\' || n || '\\K' || k END AS spec, s % 9 = 0 AS vendor FROM parts),
c AS (SELECT k, 0 AS w, 0 AS p, 'lib/' || n || '/K' || k || '.php' AS path FROM i WHERE a = 'red' AND NOT vendor UNION ALL SELECT k, 0, 1, 'lib/' || n || '.php' FROM i WHERE a = 'red' AND NOT vendor
  UNION ALL SELECT k, 1, 0, 'src/' || a || '/' || n || '/K' || k || '.php' FROM i WHERE NOT vendor UNION ALL SELECT k, 1, 1, 'src/' || a || '/' || n || '.php' FROM i WHERE NOT vendor UNION ALL SELECT k, 1, 2, 'src/' || a || '.php' FROM i WHERE NOT vendor),
h AS (SELECT c.k, arg_min(c.path, (w, p)) AS target FROM c JOIN files f ON f.path = c.path GROUP BY 1)
SELECT i.k, CASE WHEN target IS NOT NULL THEN 'file' WHEN vendor THEN 'external' ELSE 'not-found' END AS outcome, target FROM i LEFT JOIN h ON h.k = i.k""",
)
def psr4_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    leaf = parts.where("s % 2 = 0").select("repo", _path("src/", A(), "/", N(), "/K", K(), ".php").alias("path"))
    gear = parts.where("n = 'gear'").select("repo", _path("src/", A(), "/", N(), ".php").alias("path"))
    lib = parts.where("a = 'red' AND s > 25").select("repo", _path("lib/", N(), ".php").alias("path"))
    spec = F.when(S() % 9 == 0, _path("Vendor\\", A())).otherwise(_path("App\\", A(), "\\", N(), "\\K", K()))
    imports = parts.select("repo", "k", F.lit("web/index.php").alias("file"), spec.alias("specifier"))
    spaces = spark.createDataFrame([("r", "App\\", "src"), ("r", "App\\red\\", "lib")], "repo string, namespace string, dir string")
    return resolve.psr4(imports, spaces, leaf.unionByName(gear).unionByName(lib).distinct()).select("k", "outcome", "target")


@query(
    "snake_imports",
    f"""WITH {PARTS_SQL},
files AS (SELECT 'lib/' || a || '_' || n || '/k' || k || '.ex' AS path FROM parts WHERE s % 2 = 0 UNION SELECT 'web/' || a || '_' || n || '.exs' FROM parts WHERE n = 'bolt'),
h AS (SELECT k, arg_min(f.path, o) AS target FROM (SELECT k, 0 AS o, 'lib/' || a || '_' || n || '/k' || k || '.ex' AS path FROM parts UNION ALL SELECT k, 1, 'web/' || a || '_' || n || '.exs' FROM parts) c JOIN files f ON f.path = c.path GROUP BY 1)
SELECT p.k, CASE WHEN target IS NULL THEN 'external' ELSE 'file' END AS outcome, target FROM parts p LEFT JOIN h ON h.k = p.k""",
)
def snake_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    leaf = parts.where("s % 2 = 0").select("repo", _path("lib/", A(), "_", N(), "/k", K(), ".ex").alias("path"))
    bolt = parts.where("n = 'bolt'").select("repo", _path("web/", A(), "_", N(), ".exs").alias("path"))
    imports = parts.select("repo", "k", F.concat(F.initcap("a"), F.initcap("n"), F.lit(".K"), K()).alias("specifier"))
    roots = spark.createDataFrame([("r", "lib", 0), ("r", "web", 1), *(("r", f"none{k}/deep", k) for k in range(2, 60))], "repo string, root string, root_ord int")
    return resolve.snake_path(imports, roots, leaf.unionByName(bolt).distinct()).select("k", "outcome", "target")


@query(
    "package_directory_imports",
    f"""WITH {PARTS_SQL},
files AS (SELECT 'app/src/com/' || a || '/' || n || '/K' || k || '.java' AS path, a, n, k FROM parts WHERE s % 2 = 0),
d AS (SELECT a, n, min(path) AS path FROM files GROUP BY 1, 2), t AS (SELECT a, min(path) AS path FROM files GROUP BY 1)
SELECT p.k, CASE WHEN p.s % 11 = 0 THEN 'external' WHEN coalesce(f.path, d.path) IS NULL THEN 'external' ELSE 'file' END AS outcome, CASE WHEN p.s % 11 <> 0 THEN coalesce(f.path, d.path) END AS target
FROM parts p LEFT JOIN files f ON f.k = p.k LEFT JOIN d ON d.a = p.a AND d.n = p.n""",
)
def package_directory_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    files = parts.where("s % 2 = 0").select("repo", _path("app/src/com/", A(), "/", N(), "/K", K(), ".java").alias("path"))
    spec = F.when(S() % 11 == 0, _path("org.none.K", K())).otherwise(_path("com.", A(), ".", N(), ".K", K()))
    imports = parts.select("repo", "k", spec.alias("specifier"))
    return resolve.by_package_directory(imports, files).select("k", "outcome", "target")


@query(
    "package_uri_imports",
    f"""WITH {PARTS_SQL}
SELECT k, CASE WHEN s % 7 = 0 THEN 'external' WHEN s % 2 = 0 THEN 'file' ELSE 'not-found' END AS outcome, CASE WHEN s % 7 <> 0 AND s % 2 = 0 THEN 'packages/' || a || '/lib/' || n || '/k' || k || '.dart' END AS target FROM parts""",
)
def package_uri_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    files = parts.where("s % 2 = 0").select("repo", _path("packages/", A(), "/lib/", N(), "/k", K(), ".dart").alias("path"))
    manifests = parts.select("repo", "a").distinct().select("repo", F.col("a").alias("name"), _path("packages/", A()).alias("dir"))
    spec = F.when(S() % 7 == 0, _path("package:http/", N(), ".dart")).otherwise(_path("package:", A(), "/", N(), "/k", K(), ".dart"))
    imports = parts.select("repo", "k", F.lit("lib/main.dart").alias("file"), spec.alias("specifier"))
    return resolve.package_uri(imports, manifests, files).select("k", "outcome", "target")


@query(
    "require_imports",
    f"""WITH {PARTS_SQL}
SELECT k, CASE WHEN s % 3 = 0 THEN 'file' WHEN s % 2 = 0 THEN 'file' WHEN s % 5 = 0 THEN 'not-found' ELSE 'external' END AS outcome,
  CASE WHEN s % 3 = 0 THEN 'app/' || a || '/k' || k || '.rb' WHEN s % 2 = 0 THEN 'lib/k' || k || '.rb' END AS target FROM parts""",
)
def require_imports(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    near = parts.where("s % 3 = 0").select("repo", _path("app/", A(), "/k", K(), ".rb").alias("path"))
    lib = parts.where("s % 2 = 0").select("repo", _path("lib/k", K(), ".rb").alias("path"))
    spec = F.when((S() % 5 == 0) & (S() % 2 == 1), _path("./k", K(), ".rb")).otherwise(_path("k", K()))
    imports = parts.select("repo", "k", _path("app/", A(), "/main.rb").alias("file"), spec.alias("specifier"))
    roots = spark.createDataFrame([("r", "lib", 0), *(("r", f"none{k}/deep", k) for k in range(1, 60))], "repo string, root string, root_ord int")
    return resolve.require_path(imports, roots, near.unionByName(lib)).select("k", "outcome", "target")


def _customer_exports(spark, sf_dir):
    key = F.col("c_custkey")
    file = F.concat(F.lit("f"), key, F.lit(".ts"))
    customer = table(spark, sf_dir, "customer").select(key.alias("c"), F.lit("r").alias("repo"), file.alias("file"))
    null = F.lit(None).cast("string")
    own = customer.select("repo", "file", F.concat(F.lit("n"), F.col("c") % 4).alias("name"), null.alias("target"), null.alias("imported"), F.lit(1).alias("line"))
    extra = customer.where("c % 3 = 0").select("repo", "file", F.concat(F.lit("_x"), F.col("c") % 4).alias("name"), null.alias("target"), null.alias("imported"), F.lit(2).alias("line"))
    stars = customer.where("c % 10 = 0").select("repo", "file", F.lit(0).alias("star_ord"), F.concat(F.lit("f"), F.col("c") + 1, F.lit(".ts")).alias("target"), F.lit(9).alias("line"))
    entry = customer.where("c % 10 = 0").select("repo", F.lit("m").alias("module"), "file")
    return own.unionByName(extra), stars, entry


EXPORTS_SQL = """
x AS (SELECT c_custkey AS c, 'n' || (c_custkey % 4) AS name, 1 AS line FROM customer UNION ALL SELECT c_custkey, '_x' || (c_custkey % 4), 2 FROM customer WHERE c_custkey % 3 = 0),
pub AS (SELECT c, c AS def, name, line, 'direct' AS form FROM x WHERE c % 10 = 0
  UNION ALL SELECT t.c - 1, t.c, t.name, 9, 'star' FROM x t WHERE (t.c - 1) % 10 = 0 AND NOT EXISTS (SELECT 1 FROM x o WHERE o.c = t.c - 1 AND o.name = t.name))"""


@query(
    "exported_names",
    f"""WITH {EXPORTS_SQL} SELECT 'f' || c || '.ts' AS file, name, form, line, CASE WHEN name LIKE '!_%' ESCAPE '!' THEN 'unstable' ELSE 'stable' END AS stability FROM pub""",
)
def exported_names(spark, sf_dir):
    exports, stars, entry = _customer_exports(spark, sf_dir)
    return surface.exported_names(entry, exports, stars).select("file", "name", "form", "line", "stability")


@query(
    "exposed_names",
    f"""WITH {EXPORTS_SQL} SELECT 'f' || c || '.ts' AS file, name, line FROM x WHERE c % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM pub p WHERE p.def = x.c AND p.name = x.name)""",
)
def exposed_names(spark, sf_dir):
    exports, stars, entry = _customer_exports(spark, sf_dir)
    defined = surface.definitions(exports.select("repo", "file", "name"), exports, stars)
    published = surface.exported_names(entry, exports, stars).select("repo", "file", "name")
    public = surface.definitions(published, exports, stars).select("repo", "def_file", "def_name")
    return surface.unexpectedly_exposed(exports, entry, defined, public).select("file", "name", "line")


@query(
    "package_entrypoints",
    """SELECT 'c' || c_custkey AS module, '.' AS subpath, CASE c_nationkey % 4 WHEN 0 THEN 'c' || c_custkey || '/src/index.ts' WHEN 1 THEN 'c' || c_custkey || '/src/main.ts' ELSE 'c' || c_custkey || '/src/index.ts' END AS file FROM customer WHERE c_nationkey % 4 <> 3
UNION ALL SELECT 'c' || c_custkey, './x', 'c' || c_custkey || '/src/x.ts' FROM customer WHERE c_nationkey % 4 IN (0, 3)""",
)
def package_entrypoints(spark, sf_dir):
    kind = F.col("c_nationkey") % 4
    content = (
        F.when(kind == 0, '{"exports":{".":{"custom":"./dist/other.js","import":{"node":{"import":{"node":{"import":{"default":["./gone.js","./dist/index.js"]}}}}},"types":"./gone.d.ts"},"./x":"./src/x.ts","./*":"./src/*"}}')
        .when(kind == 1, '{"main":"lib/main.js"}')
        .when(kind == 2, '{"name":"plain"}')
        .otherwise('{"exports":{"./x":"./src/x.ts"}}')
    )
    module = F.concat(F.lit("c"), "c_custkey")
    manifests = table(spark, sf_dir, "customer").select(F.lit("r").alias("repo"), module.alias("module"), content.alias("content"))
    owned = manifests.select("repo", "module", F.explode(F.array(*[F.lit(f"/src/{n}.ts") for n in ("index", "main", "x", "other")])).alias("leaf")).select("repo", "module", F.concat("module", "leaf").alias("path"))
    return surface.entrypoints(manifests, owned).select("module", "subpath", "file")


@query(
    "pack_dependencies",
    """WITH RECURSIVE packs AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS b, max(p_size) AS v FROM part GROUP BY 1),
asked AS (SELECT DISTINCT p_type AS repo, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS b FROM part WHERE p_size = 1),
reach AS (SELECT repo, b FROM asked UNION SELECT r.repo, r.b * 2 FROM reach r JOIN packs p ON p.b = r.b WHERE r.b * 2 <= 40)
SELECT r.repo, 'b' || r.b AS pack, '1.' || p.v || '.0' AS version FROM reach r LEFT JOIN packs p ON p.b = r.b""".replace("\\\\", "\\"),
)
def pack_dependencies(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"), "p_size", "p_type", "p_partkey")
    name = F.concat(F.lit("b"), "b")
    packs = part.select(name.alias("pack"), F.concat(F.lit("1."), "p_size", F.lit(".0")).alias("version"), F.col("p_partkey").alias("pack_ord"))
    edges = part.where("b * 2 <= 40").select(name.alias("pack"), F.concat(F.lit("1."), "p_size", F.lit(".0")).alias("version"), F.lit(0).alias("dep_ord"), F.concat(F.lit("b"), F.col("b") * 2).alias("dep_pack"), F.lit("*").alias("range")).distinct()
    asked = part.where("p_size = 1").select(F.col("p_type").alias("repo"), name.alias("pack"), F.col("b").alias("request_ord")).distinct()
    resolved, missing = policy.resolve_dependencies(asked, packs, edges)
    return resolved.select("repo", "pack", "version").unionByName(missing.select("repo", "pack", F.lit(None).cast("string").alias("version")))
