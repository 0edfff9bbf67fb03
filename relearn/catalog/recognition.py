import re
from dataclasses import replace

from pyspark.sql import functions as F

from relearn.catalog import Case
from relearn.functions.ranks import pin
from relearn.functions.text import folded
from relearn.operators import recognition as rec
from relearn.operators.recognition import Thresholds
from relearn.plans.recognition import settle_images

RULES = Thresholds(mark_confidence=0.65, localization_confidence=0.65, item_confidence=0.6, red_min_ratio=0.02)


def _localizations(t):
    return t("b_localizations").withColumn(
        "mark_ids", F.when(F.col("mark_id").isNull(), F.array().cast("array<int>")).otherwise(F.array("mark_id"))
    ).drop("mark_id").withColumn("observed_raw_text", F.lit(None).cast("string"))


def _documents(t):
    """One localization document an image from its rows, with a fault planted by ``image_id % 12``."""
    k, idx = F.col("image_id") % 12, F.col("idx")
    rows = t("b_localizations").filter(~((k == 3) & (idx == 3)))
    rest = F.to_json(F.struct(
        "matched", F.when(F.col("mark_id").isNull(), F.array().cast("array<int>")).otherwise(F.array("mark_id")).alias("mark_ids"),
        F.when(F.col("l").isNotNull(), F.array("l", "t", "r", "b")).alias("bbox"), "observed_prompt_text",
        F.when((k == 5) & (idx == 1), F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence")))
    index = F.when((k == 2) & (idx == 0), F.lit('"0"')).when(k == 4, (idx + 1).cast("string")).otherwise(idx.cast("string"))
    item = F.concat(F.lit('{"index":'), index, F.lit(","), F.substr(rest, F.lit(2)))
    lists = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", item.alias("item")))).alias("x"))
    body = F.concat(F.lit('{"items":['), F.array_join(F.col("x.item"), ","), F.lit("]"), F.when(k == 1, F.lit(',"note":1')).otherwise(F.lit("")), F.lit("}"))
    return lists.select("image_id", F.when(k == 6, F.lit("no json")).when(k == 7, F.lit('{"items":[]}')).otherwise(body).alias("payload_json"))


def _read(t):
    return rec.parse_localizations(_documents(t), t("b_items"), t("b_valid_marks"))


def _items(t):
    segments = F.when(F.col("uncertain"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))
    return t("b_items").withColumn("uncertain_segments", segments).withColumn("normalized_text", F.lit(None).cast("string"))


def _pixels(t):
    """The embedding of every vector drawn as an 8 x 8 image, red where a value is high."""
    colours = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.15, "281EDC").otherwise("FAFAFA"))
    return t("embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"),
        F.unhex(F.array_join(colours, "")).alias("pixels"), (F.col("label") != 1).alias("readable"),
    )


def _located(t):
    texts = t("b_items").select("image_id", "idx", "prompt_text", "raw_text")
    rows = _localizations(t).join(texts, ["image_id", "idx"]).withColumn(
        "evidence",
        rec.evidence_matches(F.col("prompt_text"), F.col("observed_prompt_text"), F.col("raw_text"), F.col("observed_raw_text")),
    )
    return rec.with_geometry(rows, t("b_valid_marks"))


FOLD = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"
LOCATED = f"""located AS (SELECT p.*, i.prompt_text, i.raw_text, m.image_id IS NOT NULL AS known, (m.l + m.r)/2 AS cx, (m.t + m.b)/2 AS cy,
    EXISTS (SELECT 1 FROM b_valid_marks v WHERE v.image_id = p.image_id) AS has_marks,
    coalesce({FOLD.format('i.prompt_text')} <> '' AND {FOLD.format('i.prompt_text')} = {FOLD.format('p.observed_prompt_text')}, false) AS evidence
  FROM b_localizations p JOIN b_items i ON i.image_id = p.image_id AND i.idx = p.idx
  LEFT JOIN b_valid_marks m ON m.image_id = p.image_id AND m.mark_id = p.mark_id),
  fits AS (SELECT *, coalesce(matched AND l IS NOT NULL AND (r - l) * (b - t) <= 0.35 AND NOT (has_marks AND mark_id IS NULL)
    AND (mark_id IS NULL OR (known AND cx BETWEEN l AND r AND cy BETWEEN t AND b)), false) AS geometry FROM located)"""

PIXELS = """px AS (SELECT * FROM b_pixels), shown AS (SELECT vec_id AS image_id FROM embeddings WHERE label <> 1),
  box AS (SELECT x.*, CAST(greatest(0, floor(greatest(0.0, l - (r - l) * 0.08) * 8)) AS INT) AS px_left, CAST(greatest(0, floor(greatest(0.0, t - (b - t) * 0.08) * 8)) AS INT) AS px_top,
    CAST(least(8, ceil(least(1.0, r + (r - l) * 0.08) * 8)) AS INT) AS px_right, CAST(least(8, ceil(least(1.0, b + (b - t) * 0.08) * 8)) AS INT) AS px_bottom FROM wanted x
    JOIN shown s ON s.image_id = x.image_id),
  counted AS (SELECT x.image_id, x.{key}, x.px_left, x.px_top, x.px_right, x.px_bottom, count(*) AS pixel_count, count(*) FILTER (WHERE p.r >= 120 AND p.r - p.g >= 45 AND p.r - p.b >= 45
    AND p.r >= p.g * 1.35 AND p.r >= p.b * 1.35) AS red_pixel_count FROM box x JOIN px p ON p.image_id = x.image_id AND p.x >= x.px_left AND p.x < x.px_right
    AND p.y >= x.px_top AND p.y < x.px_bottom GROUP BY ALL)"""


def _candidate_images(t):
    return t("b_candidates").groupBy(F.col("image_id").alias("id")).agg(
        F.first("recognition_correction").alias("recognition_correction")
    ).withColumn("subject", F.when(F.col("id") % 2 == 0, "english")).withColumn("status", F.lit("segmented")).withColumn("question_count", F.lit(0))


def _stored(t):
    return rec.persist_filter(rec.drop_duplicate_candidates(t("b_candidates")))


IDENTITY = [FOLD.format(c) for c in ("c.instruction", "c.prompt_text", "c.ocr_text")]
KEPT = f"""ids AS (SELECT c.*, concat_ws('|', {', '.join(IDENTITY)}, coalesce({FOLD.format('c.ocr_answer')}, ''), c.question_type) AS identity FROM b_candidates c),
  kept AS (SELECT * FROM ids x WHERE collection_status = 'collected' OR NOT EXISTS (SELECT 1 FROM ids y WHERE y.image_id = x.image_id
    AND y.collection_status = 'collected' AND y.identity = x.identity)),
  stored AS (SELECT *, CASE WHEN collection_status = 'ignored' THEN 'pending_review' ELSE collection_status END AS final_status FROM kept
    WHERE NOT (collection_status = 'ignored' AND coalesce(recognition_correction IN ('false_positives', 'both'), false)))"""


def responses(t):
    """Responses per image as they arrive; an image has four items and four marks here."""
    item = F.struct(
        "raw_text", "instruction", "prompt_text", "answer", "subject", "question_type", "tags", "difficulty", "confidence",
        F.when(F.col("uncertain"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")).alias("uncertain_segments"))
    mark = F.struct("mark_id", "mark_type", F.array("l", "t", "r", "b").alias("bbox"), "confidence")
    items = t("b_items").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", item.alias("v")))).alias("i"))
    marks = t("b_marks").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("position", mark.alias("v")))).alias("m"))
    body = F.struct(F.transform("i", lambda x: x["v"]).alias("items"), F.transform("m", lambda x: x["v"]).alias("error_marks"))
    text = (
        F.when(F.col("image_id") % 23 == 5, "  ").when(F.col("image_id") % 29 == 7, F.substring(F.to_json(body), 1, 40))
        .when(F.col("image_id") % 2 == 0, F.concat(F.lit(" <output>"), F.to_json(body), F.lit("</output>"))).otherwise(F.to_json(body)))
    return items.join(marks, "image_id").select("image_id", text.alias("content"))


def settle(t, answers, images, rules=RULES, run=""):
    return settle_images(
        images, t("b_students"), t("b_accounts"), answers, _localizations(t), t("b_ocr_lines"), _pixels(t), rules, run=run)


def _flow(t, rules=RULES):
    return settle(t, responses(t), t("b_taken"), rules)


DECIDED = ["image_id", "idx", "localization_verified", "review_status", "reliable_error_mark", "bbox_source", "ocr_status",
           "collection_status", "collection_reason"]
SETTLED = ["id", "student_id", "status", "question_count", "subject", "recognition_correction", "error_code", "error_message"]
# A ratio of 1 is equality of the folded texts, which SQL can say.
EXACT = replace(RULES, support=1.0, contradiction=1.0)

CLAIMED = f"""claimed AS (SELECT i.* FROM b_taken i JOIN b_students s ON s.id = i.student_id JOIN b_accounts a ON a.id = s.account_id
    WHERE i.status = 'pending' AND a.status = 'active'),
  refused AS (SELECT id, CASE WHEN id % 23 = 5 THEN '{rec.EMPTY}' WHEN id % 29 = 7 THEN '{rec.JSON_INVALID}'
    WHEN id IN (SELECT image_id FROM b_marks WHERE mark_id <> position) THEN '{rec.SCHEMA_INVALID}' END AS code FROM claimed),
  sound AS (SELECT id AS image_id FROM refused WHERE code IS NULL)"""


def _reads(lines):
    """What lines inside a target's region say when only equal texts count."""
    fold = FOLD.format
    return f"""heard AS (SELECT DISTINCT image_id, target_idx, {fold('text')} AS f FROM {lines} WHERE confidence >= 0.85 AND length({fold('text')}) >= 2),
  said AS (SELECT DISTINCT image_id, idx, {fold('w')} AS f FROM (SELECT image_id, idx, unnest([prompt_text, raw_text, answer]) AS w FROM b_items) z
    WHERE w IS NOT NULL AND {fold('w')} <> ''),
  met AS (SELECT h.image_id, h.target_idx, bool_or(s.idx = h.target_idx) AS own, min(s.idx) AS first_idx FROM heard h
    JOIN said s ON s.image_id = h.image_id AND s.f = h.f GROUP BY ALL),
  reads AS (SELECT a.*, CASE WHEN m.own THEN 'support' WHEN m.image_id IS NOT NULL THEN 'contradict' ELSE 'inconclusive' END AS ocr_status,
    CAST(CASE WHEN m.own THEN a.target_idx ELSE m.first_idx END AS INT) AS matched_index
    FROM (SELECT DISTINCT image_id, target_idx FROM {lines}) a LEFT JOIN met m ON m.image_id = a.image_id AND m.target_idx = a.target_idx)"""


LOCAL_PIXELS = PIXELS.format(key="idx").split("WHERE label <> 1),")[1]
for _name in ("box", "counted", "wanted"):
    LOCAL_PIXELS = re.sub(rf"\b{_name}\b", f"local_{_name}", LOCAL_PIXELS)
TAGS = """array_to_string(CASE WHEN d IS NULL OR list_contains(k, d) THEN k ELSE list_append(k, d) END, ',')"""
TAGGED = f"""tagged AS (SELECT image_id, idx, {TAGS} AS tags FROM (SELECT image_id, idx,
    CASE idx WHEN 0 THEN ['拼音', '词语', '减法'] WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['错别字', '竖式', '计算'] ELSE ['老师批改', '填空', '其他'] END AS k,
    CASE question_type WHEN 'write_pinyin' THEN '拼音' WHEN 'write_word' THEN '词语' WHEN 'fill_blank' THEN '填空' WHEN 'calculation' THEN '计算'
      WHEN 'other' THEN '其他' END AS d FROM b_items) z)"""
FLOW = f"""{CLAIMED}, wanted AS (SELECT m.* FROM b_marks m JOIN sound USING (image_id)), {PIXELS.format(key='position')},
  valid AS (SELECT w.image_id, w.position AS mark_id, w.l, w.t, w.r, w.b FROM wanted w JOIN counted c ON c.image_id = w.image_id AND c.position = w.position
    WHERE w.confidence >= 0.65 AND red_pixel_count / pixel_count >= 0.02),
  tried AS (SELECT p.* FROM b_localizations p WHERE image_id IN (SELECT image_id FROM valid)),
  used AS (SELECT image_id, bool_and(coalesce(matched = (l IS NOT NULL) AND (matched OR (mark_id IS NULL AND observed_prompt_text IS NULL))
      AND (l IS NULL OR (l >= 0 AND t >= 0 AND r <= 1 AND b <= 1 AND l < r AND t < b)) AND confidence BETWEEN 0 AND 1, false)) AS ok,
    coalesce(list_sort(list(mark_id) FILTER (WHERE mark_id IS NOT NULL)), []) AS marks FROM tried GROUP BY image_id),
  standing AS (SELECT u.image_id FROM used u JOIN (SELECT image_id, list_sort(list(mark_id)) AS marks FROM valid GROUP BY 1) v
    ON v.image_id = u.image_id WHERE u.ok AND u.marks = v.marks),
  seen AS (SELECT p.*, m.image_id IS NOT NULL AS known, (m.l + m.r)/2 AS cx, (m.t + m.b)/2 AS cy,
    coalesce({FOLD.format('i.prompt_text')} <> '' AND {FOLD.format('i.prompt_text')} = {FOLD.format('p.observed_prompt_text')}, false) AS evidence
    FROM tried p JOIN standing s ON s.image_id = p.image_id JOIN b_items i ON i.image_id = p.image_id AND i.idx = p.idx
    LEFT JOIN valid m ON m.image_id = p.image_id AND m.mark_id = p.mark_id),
  local_wanted AS (SELECT image_id, idx, l, t, r, b FROM seen WHERE matched AND l IS NOT NULL AND confidence >= 0.65
    AND (r - l) * (b - t) <= 0.35 AND evidence AND mark_id IS NULL), {LOCAL_PIXELS},
  fits AS (SELECT s.*, coalesce(c.red_pixel_count / c.pixel_count >= 0.02, false) AS red FROM seen s
    LEFT JOIN local_counted c ON c.image_id = s.image_id AND c.idx = s.idx),
  trusted AS (SELECT *, coalesce(confidence >= 0.65 AND evidence AND matched AND l IS NOT NULL AND (r - l) * (b - t) <= 0.35
    AND (mark_id IS NOT NULL OR red) AND (mark_id IS NULL OR (known AND cx BETWEEN l AND r AND cy BETWEEN t AND b)), false) AS ok FROM fits),
  judged AS (SELECT i.*, coalesce(v.ok, false) AS verified, coalesce(v.ok AND (v.red OR v.mark_id IS NOT NULL), false) AS marked,
    CASE WHEN v.ok AND v.red AND v.mark_id IS NULL THEN 'local_red_verified_context' WHEN v.ok THEN 'marker_focused_context' ELSE 'unverified' END AS source
    FROM b_items i JOIN sound USING (image_id) LEFT JOIN trusted v ON v.image_id = i.image_id AND v.idx = i.idx),
  cropped AS (SELECT l.* FROM b_ocr_lines l JOIN judged j ON j.image_id = l.image_id AND j.idx = l.target_idx WHERE j.verified),
  {_reads('cropped')},
  read AS (SELECT j.*, coalesce(r.ocr_status, 'unavailable') AS ocr_status, CASE WHEN j.confidence < 0.6 OR j.uncertain OR NOT j.verified
      OR r.ocr_status = 'contradict' THEN 'needs_review' ELSE 'confirmed' END AS review_status, CASE WHEN r.ocr_status = 'contradict' THEN 'unverified' ELSE source END AS bbox_source,
      {FOLD.format('raw_text')} AS given, coalesce({FOLD.format('answer')}, '') AS correct
    FROM judged j LEFT JOIN reads r ON r.image_id = j.image_id AND r.target_idx = j.idx),
  ruled AS (SELECT *, CASE WHEN given = correct AND given <> '' AND NOT marked THEN 1 WHEN review_status <> 'confirmed' THEN 2 WHEN given = '' OR correct = '' THEN 3
    WHEN marked AND given <> correct THEN 4 WHEN given = correct THEN 5 ELSE 6 END AS rule,
    concat_ws('|', {FOLD.format('instruction')}, {FOLD.format('prompt_text')}, given, correct, question_type) AS identity FROM read),
  saved AS (SELECT x.*, c.recognition_correction FROM ruled x JOIN claimed c ON c.id = x.image_id WHERE (rule = 4 OR NOT EXISTS (SELECT 1 FROM ruled y
      WHERE y.image_id = x.image_id AND y.rule = 4 AND y.identity = x.identity)) AND NOT (rule = 1 AND coalesce(recognition_correction = 'both', false)))"""
FLOW_CANDIDATES = f"""WITH {FLOW}, {TAGGED} SELECT s.image_id, s.idx, verified AS localization_verified, review_status, marked AS reliable_error_mark, bbox_source, ocr_status,
  CASE rule WHEN 4 THEN 'collected' ELSE 'pending_review' END AS collection_status,
  CASE rule WHEN 1 THEN '{rec.REASON_MATCH_UNMARKED}' WHEN 2 THEN '{rec.REASON_UNCERTAIN}' WHEN 3 THEN '{rec.REASON_NO_ANSWER}'
    WHEN 4 THEN '{rec.REASON_COLLECTED}' WHEN 5 THEN '{rec.REASON_CONTRADICTION}' ELSE '{rec.REASON_NO_MARK}' END AS collection_reason, g.tags
  FROM saved s JOIN tagged g ON g.image_id = s.image_id AND g.idx = s.idx"""
_MESSAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rec.FAILURE_MESSAGES.items())
FLOW_IMAGES = f"""WITH {FLOW}, n AS (SELECT image_id, count(*) AS n, bool_or(rule <> 4) AS open FROM saved GROUP BY 1),
  first_item AS (SELECT image_id, arg_min(subject, idx) AS subject FROM b_items GROUP BY 1)
  SELECT c.id, c.student_id, CASE WHEN r.code IS NOT NULL THEN 'failed' WHEN n.open THEN 'needs_review' ELSE 'confirmed' END AS status,
    CAST(coalesce(n.n, 0) AS INT) AS question_count, CASE WHEN r.code IS NOT NULL THEN c.subject ELSE coalesce(nullif(c.subject, ''), f.subject) END AS subject,
    CASE WHEN r.code IS NOT NULL THEN c.recognition_correction END AS recognition_correction, r.code AS error_code,
    CASE r.code {_MESSAGES} END AS error_message
  FROM claimed c JOIN refused r ON r.id = c.id JOIN first_item f ON f.image_id = c.id LEFT JOIN n ON n.image_id = c.id"""


def _millionths(*cols):
    return [F.round(F.col(c) * 1e6).cast("long") if isinstance(c, str) else F.round(c * 1e6).cast("long") for c in cols]


def _edges(box):
    return _millionths(*[F.get(box, F.lit(i)) for i in range(4)])


def _said(*cols):
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def _documents_said():
    """Marks, checks and localizations of the stored documents as text, numbers in millionths."""
    mark = lambda x: _said(x["mark_id"], x["mark_type"], *_edges(x["bbox"]), *_millionths(x["confidence"]))
    box = lambda x: [F.get(x["pixel_box"], F.lit(i)) for i in range(4)]
    check = lambda x: _said(
        x["mark_id"], *_millionths(x["confidence"], x["confidence_threshold"]), *box(x), x["red_pixel_count"], x["pixel_count"],
        *_millionths(x["red_pixel_ratio"], x["red_pixel_min_ratio"]), x["accepted"], x["reason"])
    doc = F.col("ocr_raw_json")
    place, red = doc["localization"], doc["localization_red_validation"]
    return [
        F.array_join(F.transform(doc["error_marks"], mark), ",").alias("error_marks"),
        F.array_join(F.transform(doc["error_mark_validation"], check), ",").alias("error_mark_validation"),
        F.array_join(doc["valid_error_mark_ids"], ",").alias("valid_error_mark_ids"),
        F.array_join(doc["rejected_error_mark_ids"], ",").alias("rejected_error_mark_ids"),
        F.when(place.isNotNull(), _said(place["index"], place["matched"], F.array_join(place["mark_ids"], "+"), *_edges(place["bbox"]),
                                        place["observed_prompt_text"], place["observed_raw_text"], *_millionths(place["confidence"]))).alias("localization"),
        F.when(red.isNotNull(), _said(*box(red), red["red_pixel_count"], red["pixel_count"], *_millionths(red["red_pixel_ratio"], red["red_pixel_min_ratio"]),
                                      red["accepted"], red["reason"], *_edges(red["bbox"]), *_millionths(red["expansion_ratio"]))).alias("localization_red_validation"),
    ]


def _micro(*cols):
    return ", ".join(f"CAST(round({c} * 1e6) AS BIGINT)" for c in cols)


MARK_CHECKS = f"""checks AS (SELECT w.*, px_left, px_top, px_right, px_bottom, red_pixel_count, pixel_count, red_pixel_count / pixel_count AS ratio,
    CASE WHEN pixel_count IS NULL THEN 'image_invalid' WHEN confidence < 0.65 THEN 'low_confidence' WHEN red_pixel_count / pixel_count < 0.02
      THEN 'insufficient_red_pixels' ELSE 'accepted' END AS reason FROM wanted w LEFT JOIN counted c ON c.image_id = w.image_id AND c.position = w.position),
  mark_docs AS (SELECT image_id, string_agg(concat_ws(':', mark_id, mark_type, {_micro('l', 't', 'r', 'b', 'confidence')}), ',' ORDER BY mark_id) AS error_marks,
    string_agg(concat_ws(':', mark_id, {_micro('confidence', '0.65')}, px_left, px_top, px_right, px_bottom, red_pixel_count, pixel_count, {_micro('ratio', '0.02')},
      reason = 'accepted', reason), ',' ORDER BY mark_id) FILTER (WHERE pixel_count IS NOT NULL) AS error_mark_validation,
    string_agg(mark_id, ',' ORDER BY mark_id) FILTER (WHERE reason = 'accepted') AS valid_error_mark_ids,
    string_agg(mark_id, ',' ORDER BY mark_id) FILTER (WHERE reason <> 'accepted') AS rejected_error_mark_ids FROM checks GROUP BY image_id),
  place_docs AS (SELECT image_id, idx, concat_ws(':', idx, matched, coalesce(CAST(mark_id AS VARCHAR), ''), {_micro('l', 't', 'r', 'b')}, observed_prompt_text, {_micro('confidence')}) AS localization FROM seen),
  red_docs AS (SELECT w.image_id, w.idx, CASE WHEN pixel_count IS NULL THEN 'false:image_invalid' ELSE concat_ws(':', px_left, px_top, px_right, px_bottom, red_pixel_count, pixel_count,
      {_micro('red_pixel_count / pixel_count', '0.02')}, red_pixel_count / pixel_count >= 0.02, CASE WHEN red_pixel_count / pixel_count >= 0.02 THEN 'accepted' ELSE 'insufficient_red_pixels' END,
      {_micro('l', 't', 'r', 'b', '0.08')}) END AS localization_red_validation
    FROM local_wanted w LEFT JOIN local_counted c ON c.image_id = w.image_id AND c.idx = w.idx)"""
QUESTION_DOCUMENTS = f"""SELECT s.image_id, s.idx, coalesce(error_marks, '') AS error_marks, coalesce(error_mark_validation, '') AS error_mark_validation,
  coalesce(valid_error_mark_ids, '') AS valid_error_mark_ids, coalesce(rejected_error_mark_ids, '') AS rejected_error_mark_ids, localization, localization_red_validation
  FROM saved s LEFT JOIN mark_docs m ON m.image_id = s.image_id LEFT JOIN place_docs p ON p.image_id = s.image_id AND p.idx = s.idx
  LEFT JOIN red_docs r ON r.image_id = s.image_id AND r.idx = s.idx"""


def _errors(t):
    return t("events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("error", "click"), "recognition").otherwise("other").alias("kind"),
        F.concat(F.lit("vision_"), "event_type").alias("code"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("user_message"),
        F.create_map(F.lit("reason"), F.col("event_type"), F.lit("secret"), F.col("props"),
                     F.lit("mark_count"), F.col("user_id").cast("string")).alias("diagnostic"),
    )


def _vision_sql():
    def item(i, *checks):
        return [f"CASE WHEN {bad} THEN 'items.{i}.{name}' END" for name, bad in checks]

    first = item(
        0, ("instruction", "p_size % 9 = 0"), ("prompt_text", "p_size % 7 = 0"), ("subject", "p_partkey % 11 = 0"),
        ("tags.1", "p_partkey % 5 = 0"), ("difficulty", "p_size % 13 = 0 OR p_size % 8 = 0"),
        ("confidence", "p_size % 10 = 0"), ("note", "p_partkey % 17 = 0"))
    second = item(1, ("question_type", "p_partkey % 23 = 0"))
    errors = f"list_filter([{', '.join(first + second)}], lambda e: e IS NOT NULL)"
    return f"""SELECT p_partkey AS response_id, len({errors}) = 0 AS valid, array_to_string(list_slice({errors}, 1, 5), ',') AS bad_fields FROM part"""


READ = """used AS (SELECT image_id, list_sort(list(mark_id) FILTER (WHERE mark_id IS NOT NULL)) AS used FROM b_localizations GROUP BY image_id),
  valid AS (SELECT image_id, list_sort(list(DISTINCT mark_id)) AS marks FROM b_valid_marks GROUP BY image_id),
  said AS (SELECT u.image_id, CASE WHEN u.image_id % 12 IN (1, 2, 5, 6, 7) THEN 'schema_invalid' WHEN u.image_id % 12 = 3 THEN 'index_count_mismatch'
      WHEN u.image_id % 12 = 4 THEN 'index_set_mismatch' WHEN len(coalesce(used, [])) <> len(list_distinct(coalesce(used, []))) THEN 'duplicate_mark_assignment'
      WHEN coalesce(used, []) <> coalesce(marks, []) THEN 'unassigned_mark' END AS reason FROM used u LEFT JOIN valid v ON v.image_id = u.image_id)"""

CASES = {
    "d1_claimable_images": Case(
        lambda t: rec.claimable_images(t("b_images"), t("b_students"), t("b_accounts")).select("id", "student_id"),
        """SELECT i.id, i.student_id FROM b_images i JOIN b_students s ON s.id = i.student_id JOIN b_accounts a ON a.id = s.account_id
           WHERE i.status = 'pending' AND a.status = 'active'""",
    ),
    "d2_validate_items": Case(
        lambda t: rec.validate_items(t("b_vision")).select("response_id", "valid", F.array_join("bad_fields", ",").alias("bad_fields")),
        _vision_sql(),
    ),
    "d2_recognized_items": Case(
        lambda t: rec.recognized_items(pin(rec.validate_items(t("b_vision"))), keep=("response_id",)).select(
            "response_id", "idx", "raw_text", "instruction", "prompt_text", "difficulty", "confidence", F.size("tags").alias("n_tags")),
        """WITH good AS (SELECT * FROM part WHERE NOT (p_size % 9 = 0 OR p_size % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 5 = 0
             OR p_size % 13 = 0 OR p_size % 8 = 0 OR p_size % 10 = 0 OR p_partkey % 17 = 0 OR p_partkey % 23 = 0))
           SELECT p_partkey AS response_id, 0 AS idx, p_name AS raw_text, p_type AS instruction, p_brand AS prompt_text,
             CAST(greatest(1, least(5, p_size - 10)) AS INT) AS difficulty, CAST(0.9 AS DOUBLE) AS confidence, 1 AS n_tags FROM good
           UNION ALL SELECT p_partkey, 1, 'second', 'i', 'p', 3, CAST(1 AS DOUBLE), 0 FROM good""",
    ),
    "d3_validate_marks": Case(
        lambda t: rec.validate_marks(t("b_marks")),
        """SELECT *, marks_sound AND ids_in_order AS valid FROM (SELECT image_id, count(*) AS n_marks,
             bool_and(mark_type IN ('circle','cross','deletion','underline','annotation','mixed') AND l >= 0 AND t >= 0 AND r <= 1 AND b <= 1 AND l < r AND t < b
               AND confidence BETWEEN 0 AND 1) AS marks_sound, bool_and(mark_id = position) AS ids_in_order FROM b_marks GROUP BY image_id) x""",
    ),
    "d4_validate_localizations": Case(
        lambda t: rec.validate_localizations(t("b_items"), _localizations(t), t("b_valid_marks")),
        """WITH sound AS (SELECT image_id, bool_and(coalesce(matched = (l IS NOT NULL) AND (matched OR (mark_id IS NULL AND observed_prompt_text IS NULL))
               AND (l IS NULL OR (l >= 0 AND t >= 0 AND r <= 1 AND b <= 1 AND l < r AND t < b)) AND confidence BETWEEN 0 AND 1, false)) AS ok,
               list_sort(list(mark_id) FILTER (WHERE mark_id IS NOT NULL)) AS used FROM b_localizations GROUP BY image_id),
             valid AS (SELECT image_id, list_sort(list(DISTINCT mark_id)) AS marks FROM b_valid_marks GROUP BY image_id)
           SELECT s.image_id, CASE WHEN NOT ok THEN 'schema_invalid' WHEN len(coalesce(used, [])) <> len(list_distinct(coalesce(used, []))) THEN 'duplicate_mark_assignment'
             WHEN coalesce(used, []) <> coalesce(marks, []) THEN 'unassigned_mark' END AS reason FROM sound s LEFT JOIN valid v ON v.image_id = s.image_id""",
    ),
    "d4_parse_localizations": Case(
        lambda t: _read(t)["verdicts"].select("image_id", "reason", F.array_join("bad_fields", ",").alias("bad_fields")),
        f"""WITH {READ} SELECT image_id, reason, CASE image_id % 12 WHEN 1 THEN 'note' WHEN 2 THEN 'items.0.index' WHEN 5 THEN 'items.1.confidence'
             WHEN 7 THEN 'items' ELSE '' END AS bad_fields FROM said""",
    ),
    "d4_parsed_rows": Case(
        lambda t: _read(t)["localizations"].select("image_id", F.col("idx").cast("int").alias("idx"), "matched", "l", "b", "observed_prompt_text", "confidence",
                                                   F.get("mark_ids", F.lit(0)).cast("int").alias("mark_id")),
        f"""WITH {READ} SELECT l.image_id, idx, matched, l, b, observed_prompt_text, confidence, mark_id
           FROM b_localizations l JOIN said s ON s.image_id = l.image_id WHERE reason IS NULL""",
    ),
    "d5_geometry_ok": Case(
        lambda t: _located(t).select("image_id", "idx", rec.geometry_ok(0.35).alias("geometry")),
        f"WITH {LOCATED} SELECT image_id, idx, geometry FROM fits",
    ),
    "d6_evidence_matches": Case(
        lambda t: _located(t).select("image_id", "idx", "evidence"), f"WITH {LOCATED} SELECT image_id, idx, evidence FROM fits"
    ),
    "d6_folded_documents": Case(
        lambda t: t("documents").select("doc_id", F.sha2(folded(F.col("text"), "identity"), 256).alias("n"),
                                        F.sha2(folded(F.col("text"), "answer"), 256).alias("n_answer")),
        r"""SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS n,
             sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]', '', 'g')) AS n_answer FROM documents""",
    ),
    "d7_display_bbox": Case(
        lambda t: _located(t).filter("matched").withColumn("box", rec.display_bbox(0.15)).select(
            "image_id", "idx", *[F.round(f"box.{c}", 6).alias(c) for c in "ltrb"]),
        f"""WITH {LOCATED}, size AS (SELECT image_id, idx, l, t, r, b, least(1.0, (r - l) * 1.3) AS w, least(1.0, (b - t) * 1.3) AS h,
             coalesce(cx, (l + r)/2) AS fx, coalesce(cy, (t + b)/2) AS fy FROM located WHERE matched),
           centre AS (SELECT *, least(greatest(fx, greatest(w/2, r - w/2)), least(1 - w/2, l + w/2)) AS x,
             least(greatest(fy, greatest(h/2, b - h/2)), least(1 - h/2, t + h/2)) AS y FROM size)
           SELECT image_id, idx, round(greatest(0.0, x - w/2), 6) AS l, round(greatest(0.0, y - h/2), 6) AS t, round(least(1.0, x + w/2), 6) AS r,
             round(least(1.0, y + h/2), 6) AS b FROM centre""",
    ),
    "d8_review_status": Case(
        lambda t: rec.review_status(_items(t), _located(t), RULES).select(
            "image_id", "idx", "localization_verified", "review_status", "reliable_error_mark", "bbox_source"),
        f"""WITH {LOCATED}, v AS (SELECT *, coalesce(confidence >= 0.65 AND geometry AND evidence, false) AS verified FROM fits)
           SELECT i.image_id, i.idx, v.verified AS localization_verified, CASE WHEN i.confidence < 0.6 OR i.uncertain OR NOT v.verified THEN 'needs_review' ELSE 'confirmed' END AS review_status,
             v.verified AND v.mark_id IS NOT NULL AS reliable_error_mark, CASE WHEN v.verified THEN 'marker_focused_context' ELSE 'unverified' END AS bbox_source
           FROM b_items i JOIN v ON v.image_id = i.image_id AND v.idx = i.idx""",
    ),
    "d9_red_evidence": Case(
        lambda t: rec.red_evidence(_pixels(t), t("b_marks"), RULES).select(
            "image_id", "position", "px_left", "px_top", "px_right", "px_bottom", "red_pixel_count", "pixel_count",
            F.round("red_pixel_ratio", 6).alias("red_pixel_ratio"), "reason", "accepted"),
        f"""WITH wanted AS (SELECT * FROM b_marks), {PIXELS.format(key='position')}
           SELECT *, reason = 'accepted' AS accepted FROM (SELECT m.image_id, m.position, px_left, px_top, px_right, px_bottom, red_pixel_count, pixel_count,
             round(red_pixel_count / pixel_count, 6) AS red_pixel_ratio, CASE WHEN pixel_count IS NULL THEN 'image_invalid' WHEN confidence < 0.65 THEN 'low_confidence'
             WHEN red_pixel_count / pixel_count < 0.02 THEN 'insufficient_red_pixels' ELSE 'accepted' END AS reason
             FROM b_marks m LEFT JOIN counted c ON c.image_id = m.image_id AND c.position = m.position) x""",
    ),
    "d10_local_red_check": Case(
        lambda t: rec.local_red_check(_pixels(t), _located(t), RULES),
        f"""WITH {LOCATED}, wanted AS (SELECT image_id, idx, l, t, r, b FROM located WHERE matched AND l IS NOT NULL AND confidence >= 0.65
             AND (r - l) * (b - t) <= 0.35 AND evidence AND has_marks AND mark_id IS NULL), {PIXELS.format(key='idx')}
           SELECT w.image_id, w.idx, coalesce(red_pixel_count / pixel_count >= 0.02, false) AS red_verified FROM wanted w
           LEFT JOIN counted c ON c.image_id = w.image_id AND c.idx = w.idx""",
    ),
    "d11_ocr_verdict": Case(lambda t: rec.ocr_verdict(t("b_ocr_lines"), t("b_items"))),
    "d11_exact_verdict": Case(
        lambda t: rec.ocr_verdict(t("b_ocr_lines"), t("b_items"), EXACT).select("image_id", "target_idx", "status", "matched_index"),
        f"WITH {_reads('b_ocr_lines')} SELECT image_id, target_idx, ocr_status AS status, matched_index FROM reads"),
    "d12_collection_decision": Case(
        lambda t: rec.collection_decision(t("b_items").select(
            "image_id", "idx", F.col("raw_text").alias("ocr_text"), F.col("answer").alias("ocr_answer"),
            F.when(F.col("uncertain"), "needs_review").otherwise("confirmed").alias("review_status"),
            (F.col("idx") != 3).alias("reliable_error_mark"))).select("image_id", "idx", "collection_status", "collection_reason"),
        f"""WITH x AS (SELECT image_id, idx, uncertain, idx <> 3 AS marked, {FOLD.format('raw_text')} AS given, coalesce({FOLD.format('answer')}, '') AS correct FROM b_items),
             y AS (SELECT *, CASE WHEN given = correct AND given <> '' AND NOT marked THEN 1 WHEN uncertain THEN 2 WHEN given = '' OR correct = '' THEN 3
               WHEN marked AND given <> correct THEN 4 WHEN given = correct THEN 5 ELSE 6 END AS rule FROM x)
           SELECT image_id, idx, CASE rule WHEN 1 THEN 'ignored' WHEN 4 THEN 'collected' ELSE 'pending_review' END AS collection_status,
             CASE rule WHEN 1 THEN '{rec.REASON_MATCH_UNMARKED}' WHEN 2 THEN '{rec.REASON_UNCERTAIN}' WHEN 3 THEN '{rec.REASON_NO_ANSWER}'
               WHEN 4 THEN '{rec.REASON_COLLECTED}' WHEN 5 THEN '{rec.REASON_CONTRADICTION}' ELSE '{rec.REASON_NO_MARK}' END AS collection_reason FROM y""",
    ),
    "d13_normalize_tags": Case(
        lambda t: t("b_items").select("image_id", "idx", F.array_join(rec.normalize_tags(F.col("tags"), F.col("question_type")), ",").alias("tags")),
        f"WITH {TAGGED} SELECT * FROM tagged",
    ),
    "d14_drop_duplicate_candidates": Case(
        lambda t: rec.drop_duplicate_candidates(t("b_candidates")).select("image_id", "idx", "collection_status"),
        f"WITH {KEPT} SELECT image_id, idx, collection_status FROM kept",
    ),
    "d15_persist_filter": Case(
        lambda t: _stored(t).select("image_id", "idx", "collection_status"),
        f"WITH {KEPT} SELECT image_id, idx, final_status AS collection_status FROM stored",
    ),
    "d16_image_rollup": Case(
        lambda t: rec.image_rollup(_candidate_images(t), _stored(t), t("b_items")).select("id", "status", "question_count", "subject"),
        f"""WITH {KEPT}, n AS (SELECT image_id, count(*) AS n, bool_or(final_status = 'pending_review') AS p FROM stored GROUP BY 1)
           SELECT i.image_id AS id, CASE WHEN n.p THEN 'needs_review' ELSE 'confirmed' END AS status, CAST(coalesce(n.n, 0) AS INT) AS question_count,
             CASE WHEN i.image_id % 2 = 0 THEN 'english' ELSE i.subject END AS subject
           FROM (SELECT image_id, arg_min(subject, idx) AS subject FROM b_items GROUP BY 1) i LEFT JOIN n ON n.image_id = i.image_id""",
    ),
    "d17_recognition_candidates": Case(
        lambda t: _flow(t)["candidates"].select(*DECIDED, F.array_join("tags", ",").alias("tags"))),
    "d17_recognition_images": Case(lambda t: _flow(t)["images"].select(*SETTLED)),
    "d17_exact_candidates": Case(
        lambda t: _flow(t, EXACT)["candidates"].select(*DECIDED, F.array_join("tags", ",").alias("tags")), FLOW_CANDIDATES),
    "d17_exact_images": Case(lambda t: _flow(t, EXACT)["images"].select(*SETTLED), FLOW_IMAGES),
    "d17_question_rows": Case(
        lambda t: _flow(t, EXACT)["questions"].select(
            "image_id", "idx", "student_id", "grade", "semester", "collection_status", "crop_region.localization_status",
            F.col("crop_region.bbox_source").alias("bbox_source"), F.col("ocr_raw_json.prompt_text").alias("prompt_text"),
            F.col("ocr_raw_json.collection_reason").alias("collection_reason"), F.col("ocr_raw_json.local_ocr.status").alias("ocr_status"),
            *_documents_said()),
        f"""WITH decided AS ({FLOW_CANDIDATES}), documented AS (WITH {FLOW}, {MARK_CHECKS} {QUESTION_DOCUMENTS})
           SELECT d.image_id, d.idx, c.student_id, c.grade, c.semester, d.collection_status, CASE WHEN d.bbox_source = 'unverified' THEN 'needs_review' ELSE 'verified' END AS localization_status,
             d.bbox_source, i.prompt_text, d.collection_reason, d.ocr_status, error_marks, error_mark_validation, valid_error_mark_ids,
             rejected_error_mark_ids, localization, localization_red_validation FROM decided d JOIN b_taken c ON c.id = d.image_id
             JOIN b_items i ON i.image_id = d.image_id AND i.idx = d.idx JOIN documented o ON o.image_id = d.image_id AND o.idx = d.idx"""),
    "d18_failure_code": Case(
        lambda t: rec.failure_code(_errors(t)).select(
            "id", "error_code", "error_message",
            F.concat_ws("|", F.try_element_at("safe_diagnostic", F.lit("reason")), F.try_element_at("safe_diagnostic", F.lit("mark_count")),
                        F.try_element_at("safe_diagnostic", F.lit("secret"))).alias("diagnostic")),
        f"""SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'vision_error' WHEN 'click' THEN '{rec.INVALID_RESPONSE[0]}' ELSE '{rec.INTERNAL_ERROR[0]}' END AS error_code,
             CASE event_type WHEN 'error' THEN props WHEN 'click' THEN '{rec.INVALID_RESPONSE[1]}' ELSE '{rec.INTERNAL_ERROR[1]}' END AS error_message,
             CASE WHEN event_type IN ('error', 'click') THEN event_type || '|' || user_id ELSE '' END AS diagnostic FROM events""",
    ),
    "d19_pixel_crop_box": Case(
        lambda t: t("b_localizations").withColumn(
            "box", rec.pixel_crop_box(F.col("l"), F.col("t"), F.col("r") + F.when(F.col("idx") == 1, 0.5).otherwise(0.0), F.col("b"),
                                      F.lit(640), (F.col("image_id") % 7 + 2).cast("int"))).select("image_id", "idx", "box.*"),
        """SELECT image_id, idx, CASE WHEN ok THEN x0 END AS "left", CASE WHEN ok THEN y0 END AS top,
             CASE WHEN ok THEN CAST(greatest(x0 + 1, least(640, ceil(r2 * 640))) AS INT) END AS "right",
             CASE WHEN ok THEN CAST(greatest(y0 + 1, least(h, ceil(b * h))) AS INT) END AS bottom FROM (
           SELECT *, coalesce(l >= 0 AND l < r2 AND r2 <= 1 AND t >= 0 AND t < b AND b <= 1, false) AS ok,
             CAST(greatest(0, least(639, floor(l * 640))) AS INT) AS x0, CAST(greatest(0, least(h - 1, floor(t * h))) AS INT) AS y0 FROM (
           SELECT *, r + CASE WHEN idx = 1 THEN 0.5 ELSE 0.0 END AS r2, CAST(image_id % 7 + 2 AS INT) AS h FROM b_localizations) p) q""",
    ),
}
