"""Decisions on faces: evidence, two passes, staged faces, two-stage search, splits, merges, representatives."""

from pyspark.sql import functions as F

from kithgraph.functions import scoring as s
from kithgraph.functions import vectors as x
from kithgraph.operators import clustering as k
from kithgraph.operators import matching as m
from kithgraph.operators import greedy, people
from kithgraph.plans.catalog import query
from kithgraph.plans.vectors import PLANTED, planted
from kithgraph.sources.storage import saved

BOOST = "greatest(-0.08, least(0.08, (least(1, greatest(0, {q} / 100)) - 0.5) * 0.2))"
ZONE = "CASE WHEN {s} >= 0.62 THEN 'SAFE_SAME' WHEN {s} >= 0.35 THEN 'UNCERTAIN' ELSE 'SAFE_DIFFERENT' END"
LIFTED = "round(sim + CASE WHEN face_id % 4 = 0 THEN 0.05 ELSE 0 END, 6)"

EVIDENCE = PLANTED + """, w AS (SELECT *, {boost} AS boost FROM f),
p AS (SELECT a.face_id, a.quality_score, b.cluster_id, round(greatest(-1, least(1, list_dot_product(a.v, b.v) + a.boost)), 6) AS sim FROM w a JOIN f b ON b.quality_score >= 65),
s AS (SELECT face_id, quality_score, cluster_id, max(sim) AS sim, count(*) FILTER (sim >= 0.35) AS support FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY sim DESC, cluster_id) AS n, lead(sim) OVER (PARTITION BY face_id ORDER BY sim DESC, cluster_id) AS second FROM s),
d AS (SELECT face_id, quality_score, cluster_id, sim, round(coalesce(sim - second, 1), 6) AS gap, support, """ + ZONE.format(s=LIFTED) + """ AS zone FROM r WHERE n = 1)
"""
WEIGHTED = EVIDENCE.replace("{boost}", BOOST.format(q="quality_score"))


def evidence(v, weighted):
    faces = saved(planted(v))
    anchors = faces.filter("quality_score >= 65").select(F.col("face_id").alias("id"), F.col("v").alias("vector"), "cluster_id")
    return m.match_evidence(faces.select(F.col("face_id").alias("id"), F.col("v").alias("vector"), F.col("quality_score").alias("quality")), anchors, weighted)


def decided(v):
    return m.anchor_decision(evidence(v, True), F.col("face_id") % 4 == 0)


@query("v8_match_evidence", EVIDENCE.replace("{boost}", "0") + "SELECT face_id, cluster_id, sim, gap, support FROM d", raw=True)
def match_evidence(v):
    return evidence(v, False)


@query("k7_anchor_decision", WEIGHTED + "SELECT face_id, cluster_id, sim, gap, support, zone, zone = 'UNCERTAIN' AND NOT (support >= 1 AND gap >= 0.10) AS more_evidence FROM d", raw=True)
def anchor_decision(v):
    return decided(v)


K9 = WEIGHTED + """SELECT face_id, CASE WHEN sim >= 0.55 AND ok THEN cluster_id END AS cluster_id, CASE WHEN sim >= 0.55 AND ok THEN 'ASSIGNED' WHEN sim < 0.55 AND face_id % 20 >= 10 AND quality_score >= 65 THEN 'NEW' ELSE 'KEPT' END AS outcome
FROM (SELECT *, zone <> 'UNCERTAIN' OR gap >= 0.10 OR support >= 2 OR sim >= 0.62 AS ok FROM d)"""


@query("k9_second_pass", K9, raw=True)
def second_pass(v):
    """Every face as if deferred ``face_id % 20`` minutes ago."""
    more = planted(v).select("face_id", F.col("quality_score").alias("quality"), (F.col("face_id") % 20).alias("minutes"))
    return m.second_pass(decided(v).join(more, "face_id"))


@query("k8_first_pass")
def first_pass(v):
    """All faces against the anchors of a third of them; faces of one photo must not share a cluster."""
    tier = F.when(F.col("quality_score") >= 65, "ANCHOR").when(F.col("quality_score") >= 50, "CLUSTERING").when(F.col("quality_score") >= 40, "DISPLAY_ONLY").otherwise("REJECTED")
    faces = saved(planted(v))
    anchors = faces.filter("quality_score >= 65 AND face_id % 3 = 0").select(F.col("face_id").alias("id"), F.col("v").alias("vector"), "cluster_id")
    new = faces.filter("face_id % 3 <> 0")
    constraints = people.same_photo_constraints(new.select("photo_id", "face_id"), None)
    return greedy.first_pass(new.select(F.col("face_id").alias("id"), F.col("v").alias("vector"), F.col("quality_score").alias("quality"), tier.alias("tier")), anchors, constraints)


def top_faces(v, most=m.REPRESENTATIVES):
    return people.top_n(planted(v), ["cluster_id"], [F.col("quality_score").desc(), F.col("face_id")], most)


K6 = PLANTED + f""", st AS (SELECT *, CASE WHEN face_id % 3 = 0 THEN (cluster_id + 1) % 10 ELSE cluster_id END AS candidate, {BOOST.format(q="quality_score")} AS boost FROM f),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, face_id) AS n FROM f) WHERE n <= 7),
ow AS (SELECT st.face_id, max(round(greatest(-1, least(1, list_dot_product(st.v, rp.v) + boost)), 6)) AS own FROM st JOIN rp ON rp.cluster_id = st.candidate GROUP BY 1),
ot AS (SELECT st.face_id, max(round(greatest(-1, least(1, round(list_dot_product(st.v, m.c), 6) + boost)), 6)) AS other FROM st JOIN m ON m.cluster_id <> st.candidate GROUP BY 1),
z AS (SELECT st.face_id, st.quality_score, candidate, greatest(coalesce(own, 0), 0) AS sim, greatest(coalesce(other, 0), 0) AS other FROM st LEFT JOIN ow USING (face_id) LEFT JOIN ot USING (face_id)),
zc AS (SELECT *, round(sim - other, 6) < 0.08 AND other >= 0.42 AS conflict FROM z),
vf AS (SELECT *, CASE WHEN sim >= 0.52 AND NOT conflict THEN 'MEDIUM' WHEN sim >= 0.62 THEN 'HIGH' WHEN conflict THEN 'STAGED' WHEN sim < 0.42 THEN 'NEW_CLUSTER' ELSE 'STAGED' END AS confidence FROM zc)
"""


def verified(v, candidate=None):
    wrong = F.when(F.col("face_id") % 3 == 0, (F.col("cluster_id") + 1) % 10).otherwise(F.col("cluster_id"))
    faces = planted(v)
    staged = faces.select("face_id", "v", "quality_score", (candidate if candidate is not None else wrong).alias("candidate"))
    return m.verify_staged(staged, top_faces(v).select(F.col("cluster_id").alias("candidate"), F.col("v").alias("w")), x.centroids(faces, "cluster_id", "v"))


@query("k6_verify_staged", K6 + "SELECT face_id, CASE WHEN confidence <> 'NEW_CLUSTER' THEN candidate END AS cluster_id, sim, other, conflict, confidence FROM vf", raw=True)
def verify_staged(v):
    return verified(v)


K21 = K6.replace("CASE WHEN face_id % 3 = 0 THEN (cluster_id + 1) % 10 ELSE cluster_id END AS candidate", "CASE WHEN face_id % 11 = 5 THEN NULL WHEN face_id % 3 = 0 THEN (cluster_id + 1) % 10 ELSE cluster_id END AS candidate").replace("m.cluster_id <> st.candidate", "(st.candidate IS NULL OR m.cluster_id <> st.candidate)") + """,
cm AS (SELECT *, candidate IS NULL OR face_id % 17 = 16 OR confidence = 'NEW_CLUSTER' OR (confidence = 'STAGED' AND sim < 0.42) AS fresh FROM vf)
"""
K21_FACES = """SELECT face_id, CASE WHEN fresh THEN concat('n', face_id) ELSE concat('c', candidate) END AS cluster, CASE WHEN fresh THEN 1 ELSE sim END::double AS match_score,
 CASE WHEN fresh THEN 'NEW' ELSE confidence END AS assignment_confidence, NOT fresh AND (confidence = 'HIGH' OR (confidence = 'MEDIUM' AND quality_score >= 60)) AS moves_centroid, fresh AS new_person FROM cm"""


def committed(v):
    """Every eleventh face has no candidate; every seventeenth waited 64 seconds."""
    candidate = F.when(F.col("face_id") % 11 == 5, None).when(F.col("face_id") % 3 == 0, (F.col("cluster_id") + 1) % 10).otherwise(F.col("cluster_id"))
    waited = planted(v).select("face_id", "quality_score", (F.col("face_id") % 17 * 4000).alias("waited_ms"))
    return m.commit_staged(verified(v, candidate), waited)


@query("k21_commit_staged", K21 + K21_FACES, raw=True)
def commit_staged(v):
    return committed(v)


@query("k21_founded", K21 + "SELECT concat('p', face_id) AS person_id, face_id AS representative_face_id, row_number() OVER (ORDER BY face_id) + 100 AS display_number, concat('n', face_id) AS cluster_id, 1 AS face_count, 1 AS photo_count FROM cm WHERE fresh", raw=True)
def founded(v):
    """Persons and clusters of the faces that found one, numbered after a hundred persons."""
    persons, clusters = m.founded(saved(committed(v)), 101)
    return persons.join(clusters, "person_id").select("person_id", "representative_face_id", "display_number", "cluster_id", "face_count", "photo_count")


V10 = PLANTED + f""", pe AS (SELECT photo_id, i, avg(v[i]) AS c FROM f, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), pm AS (SELECT photo_id AS cluster_id, list(c ORDER BY i) AS c FROM pe GROUP BY 1),
nn AS (SELECT face_id, f.photo_id, pm.cluster_id, v, {BOOST.format(q="quality_score")} AS boost, round(list_dot_product(v, c), 6) AS middle, row_number() OVER (PARTITION BY face_id ORDER BY round(list_dot_product(v, c), 6) DESC, pm.cluster_id) AS rank FROM f, pm),
ee AS (SELECT nn.face_id, nn.cluster_id, rank, max(CASE WHEN r.photo_id <> nn.photo_id THEN round(greatest(-1, least(1, list_dot_product(nn.v, r.v) + boost)), 6) END) AS sim FROM nn JOIN f r ON r.photo_id = nn.cluster_id WHERE rank <= 50 AND middle >= 0.15 GROUP BY 1, 2, 3),
pk AS (SELECT *, row_number() OVER (PARTITION BY face_id, rank <= 25 ORDER BY sim DESC, rank) AS n FROM ee WHERE sim > 0),
cn AS (SELECT face_id, count(*) FILTER (rank <= 25) AS n_a, count(*) AS n FROM ee GROUP BY 1),
ab AS (SELECT f.face_id, coalesce(a.sim, 0) AS best, a.cluster_id AS ca, b.sim AS sb, b.cluster_id AS cb, coalesce(cn.n, 0) AS n, coalesce(cn.n_a, 0) AS n_a FROM f LEFT JOIN cn USING (face_id)
 LEFT JOIN pk a ON a.face_id = f.face_id AND a.n = 1 AND a.rank <= 25 LEFT JOIN pk b ON b.face_id = f.face_id AND b.n = 1 AND b.rank > 25),
fin AS (SELECT face_id, best < 0.62 AND best > 0.20 AS wide, coalesce(sb > best, false) AS better, CASE WHEN best < 0.62 AND best > 0.20 AND sb > best THEN sb ELSE best END AS sim, CASE WHEN best < 0.62 AND best > 0.20 AND sb > best THEN cb ELSE ca END AS cluster_id, n, n_a FROM ab)
SELECT face_id, CASE WHEN sim >= 0.52 THEN cluster_id END AS cluster_id, sim::double AS sim, CASE WHEN sim >= 0.62 THEN 'HIGH' WHEN sim >= 0.52 THEN 'MEDIUM' ELSE 'NEW_CLUSTER' END AS confidence, CASE WHEN wide AND better THEN n - n_a ELSE n_a END AS checked FROM fin"""


@query("v10_two_stage", V10, raw=True)
def two_stage(v):
    """Photos as clusters, their own faces as representatives."""
    faces = saved(planted(v))
    clusters = faces.select(F.col("photo_id").alias("cluster_id"), "face_id", "v", "quality_score")
    reps = people.top_n(clusters, ["cluster_id"], [F.col("quality_score").desc(), F.col("face_id")], m.REPRESENTATIVES).select("cluster_id", F.col("v").alias("w"), F.col("cluster_id").alias("rep_photo"))
    return m.match_two_stage(faces, x.centroids(clusters, "cluster_id", "v"), reps)


def quarters(v, n=4):
    """The planted clusters cut in n, so that there is something to merge."""
    return planted(v).withColumn("cluster_id", F.col("cluster_id") * n + F.col("face_id") % n)


QUARTERS = PLANTED + """, g AS (SELECT * REPLACE (cluster_id * 4 + face_id % 4 AS cluster_id) FROM f), ge AS (SELECT cluster_id, i, avg(v[i]) AS c, count(*) AS n FROM g, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
gu AS (SELECT cluster_id, max(n) AS n, list(c ORDER BY i) AS c FROM ge GROUP BY 1), gm AS (SELECT cluster_id, n, list_transform(c, lambda z: z / sqrt(list_dot_product(c, c))) AS c FROM gu)
"""
K14 = QUARTERS + "SELECT CASE WHEN a.n >= b.n THEN b.cluster_id ELSE a.cluster_id END AS source, CASE WHEN a.n >= b.n THEN a.cluster_id ELSE b.cluster_id END AS target, round(list_dot_product(a.c, b.c), 6) AS sim, CASE WHEN round(list_dot_product(a.c, b.c), 6) >= 0.62 THEN 'likely' WHEN round(list_dot_product(a.c, b.c), 6) >= 0.58 THEN 'possible' ELSE 'uncertain' END AS label FROM gm a JOIN gm b ON a.cluster_id < b.cluster_id WHERE list_dot_product(a.c, b.c) >= {least}"


@query("k14_merge_candidates", K14.format(least=0.75), raw=True)
def merge_candidates(v):
    return k.merge_candidates(x.centroids(quarters(v), "cluster_id", "v", normalize=True), s.MERGE)


@query("k14_merge_suggestions", K14.format(least=0.45).replace("* 4 + face_id % 4", "* 50 + face_id % 50") + " AND round(list_dot_product(a.c, b.c), 6) < 0.75", raw=True)
def merge_suggestions(v):
    return k.merge_candidates(x.centroids(quarters(v, 50), "cluster_id", "v", normalize=True), s.SUGGEST).filter(F.col("sim") < s.MERGE)


@query("k15_auto_merge")
def auto_merge(v):
    """Every two quarters have one person; which cluster goes into which, and whose it is then."""
    middles = x.centroids(quarters(v), "cluster_id", "v", normalize=True)
    return k.auto_merge(middles.withColumn("person_id", F.floor(F.col("cluster_id") / 2)))[0]


@query("k18_maintain_representatives")
def maintain(v):
    """The last face of each cluster against its seven best others."""
    faces = planted(v).withColumn("pose", s.pose(F.col("yaw")))
    new = people.best_per_group(faces, ["cluster_id"], [F.col("face_id").desc()]).select("cluster_id", "face_id", "v", "quality_score", "pose")
    rest = faces.join(new.select("face_id"), "face_id", "left_anti")
    order = [F.col("quality_score").desc(), F.col("face_id")]
    held = people.compact_ranks(people.top_n(rest, ["cluster_id"], order, m.REPRESENTATIVES), ["cluster_id"], order)
    return m.maintain_representatives(new, held.select("cluster_id", "face_id", "v", "quality_score", "pose", "rank"))


def parts(v):
    return m.subgroups(planted(v).withColumn("confidence", (F.col("face_id") * 11) % 97))


@query("k19_subgroups")
def subgroups(v):
    return parts(v)


@query("r1_split_candidates")
def split_candidates(v):
    """Every two planted clusters as one, which should be split again."""
    faces = pairs_as_one(v)
    return m.split_candidates(faces, m.subgroups(faces))


def pairs_as_one(v):
    return planted(v).withColumn("cluster_id", F.floor(F.col("cluster_id") / 2)).withColumn("confidence", (F.col("face_id") * 11) % 97)


R2 = QUARTERS + """, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, face_id) AS n FROM g) WHERE n <= 7),
p AS (SELECT a.cluster_id AS a, b.cluster_id AS b, round(list_dot_product(a.c, b.c), 6) AS sim FROM gm a JOIN gm b ON a.cluster_id < b.cluster_id WHERE list_dot_product(a.c, b.c) >= 0.40),
q AS (SELECT p.a, p.b, p.sim, max(round(list_dot_product(x.v, y.v), 6)) AS representative FROM p JOIN r x ON x.cluster_id = p.a JOIN r y ON y.cluster_id = p.b GROUP BY 1, 2, 3),
c AS (SELECT *, round(greatest(0, least(0.3, sim - 0.5)) / 0.3 * 0.3 + greatest(0, least(0.25, representative - 0.55)) / 0.25 * 0.7, 6) AS confidence FROM q WHERE representative >= 0.55)
SELECT a, b, sim, representative, confidence, confidence >= 0.70 AS auto FROM c"""


@query("r2_merge_review", R2, raw=True)
def merge_review(v):
    return m.merge_review(quarters(v), 0.40, 0.55)


@query("r3_refine")
def refine(v):
    """One row: what the review finds to merge and to split, and what the repair mended, all on the same clusters."""
    faces, clusters = review(v)
    merges = m.merge_review(faces, 0.40, 0.55).agg(F.count("*").alias("merges"), F.count_if("auto").alias("auto_merges"))
    splits = m.split_candidates(faces, m.subgroups(faces)).agg(F.count("*").alias("splits"), F.count_if("auto").alias("auto_splits"))
    mended = m.repair(clusters, faces, 100).agg(F.count_if("added").alias("missing"), F.count_if(F.col("outcome") == "DELETED").alias("empty"), F.count_if("recounted").alias("recounts"), F.count_if(F.col("outcome") == "LINKED").alias("orphans"))
    # Three tables of one row each.
    return merges.join(F.broadcast(splits), F.lit(True)).join(F.broadcast(mended), F.lit(True))


def review(v):
    """Pairs of planted clusters cut in four, and a cluster table that lacks some, counts some wrongly, holds empty ones and some without person."""
    faces = saved(pairs_as_one(v).withColumn("cluster_id", F.col("cluster_id") * 4 + F.col("face_id") % 4))
    counted = faces.groupBy("cluster_id").agg(F.count("*").alias("n"))
    there = counted.filter("cluster_id % 7 <> 6").select("cluster_id", (F.col("n") + F.col("cluster_id") % 2).alias("face_count"), F.when(F.col("cluster_id") % 5 != 4, F.col("cluster_id")).alias("person_id"))
    empty = v.table("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("cluster_id"), F.lit(3).cast("long").alias("face_count"), F.lit(None).cast("long").alias("person_id"))
    return faces, there.unionByName(empty)


R3 = PLANTED + """, g AS (SELECT cluster_id // 2 * 4 + face_id % 4 AS cluster_id, photo_id FROM f), n AS (SELECT cluster_id, count(*) AS n, count(DISTINCT photo_id) AS photos FROM g GROUP BY 1),
t AS (SELECT cluster_id, n + cluster_id % 2 AS face_count, CASE WHEN cluster_id % 5 <> 4 THEN cluster_id END AS person_id FROM n WHERE cluster_id % 7 <> 6 UNION ALL SELECT n_nationkey + 1000, 3, NULL FROM nation),
b AS (SELECT coalesce(t.cluster_id, n.cluster_id) AS cluster_id, t.cluster_id IS NULL AS added, n, photos, face_count, person_id FROM t FULL JOIN n ON t.cluster_id = n.cluster_id)
SELECT cluster_id, added, coalesce(n, 0) AS face_count, coalesce(photos, 0) AS photos, coalesce(face_count <> n, false) AS recounted, CASE WHEN n IS NULL THEN 'DELETED' WHEN person_id IS NULL THEN 'LINKED' ELSE 'KEPT' END AS outcome,
 CASE WHEN n IS NOT NULL AND person_id IS NULL THEN 100 + row_number() OVER (PARTITION BY n IS NOT NULL AND person_id IS NULL ORDER BY cluster_id) END AS display_number FROM b"""


@query("r3_repair", R3, raw=True)
def repair(v):
    """The cluster table after the repair."""
    faces, clusters = review(v)
    return m.repair(clusters, faces, 100)
