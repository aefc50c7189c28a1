"""Registered queries of the review site's predicates and policies, each beside nested SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.operators import policy, review_policies
from cloakwork.operators import review_site as S
from cloakwork.operators.conditions import keep
from cloakwork.operators.review_policies import POLICIES, WEAKER
from cloakwork.operators.review_site import ADMIN, CHAIR, PC, REVIEWER, Site
from cloakwork.sources.catalog import update

ME = "u7@x.org"
N = "(SELECT count(*) FROM customer)"
#: The site's tables, made from the driver's; the text serves both engines.
SITE = {
    "ContactInfo": "SELECT c_custkey AS contactId, concat('u', c_custkey, '@x.org') AS email, concat('F', c_custkey % 50) AS firstName, concat('L', c_nationkey) AS lastName, (c_custkey * 5) % 128 AS roles FROM customer",
    "Paper": f"SELECT o_orderkey AS paperId, concat('F', o_custkey % 50, chr(9), CASE WHEN o_orderkey % 50 = 1 THEN 'L' ELSE 'K' END, o_orderkey % 25, chr(9), CASE WHEN o_orderkey % 40 = 0 THEN 'u' ELSE 'U' END, o_custkey, '@x.org', chr(10)) AS authorInformation, o_custkey + 1 AS shepherdContactId, (o_orderkey * 7 + 3) % {N} AS managerContactId, o_orderkey % 3 AS timeSubmitted, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS timeWithdrawn, o_orderkey % 4 - 1 AS outcome FROM orders",
    "PaperConflict": f"SELECT o_orderkey AS paperId, (o_orderkey * 11 + 2) % {N} AS contactId, o_orderkey % 12 AS conflictType FROM orders UNION ALL SELECT o_orderkey, o_custkey, (o_orderkey + o_custkey) % 12 FROM orders",
    "PaperReview": "SELECT l_orderkey * 10 + l_linenumber AS reviewId, l_orderkey AS paperId, l_suppkey AS contactId, l_partkey % 100 AS requestedBy, l_linenumber % 2 AS reviewSubmitted, l_linenumber % 3 - 1 AS reviewNeedsSubmit FROM lineitem",
    "ReviewRating": "SELECT l_orderkey * 10 + l_linenumber AS reviewId, CAST(l_quantity AS INT) % 5 AS rating FROM lineitem",
    "PaperReviewPreference": "SELECT o_orderkey AS paperId, o_custkey AS contactId FROM orders",
    "PaperComment": "SELECT l_orderkey * 10 + l_linenumber AS commentId, l_orderkey AS paperId, l_linenumber * 65536 + l_orderkey % 2 AS commentType, l_linenumber % 3 AS authorOrdinal, l_linenumber % 2 AS ordinal FROM lineitem",
    "TopicInterest": "SELECT c_custkey AS contactId, c_nationkey AS topicId FROM customer",
    "PaperTag": "SELECT o_orderkey AS paperId, o_orderstatus AS tag FROM orders",
    "ReviewRequest": "SELECT l_orderkey AS paperId, l_linenumber AS n, l_partkey % 100 AS requestedBy FROM lineitem",
    "users": "SELECT concat('u', c_custkey) AS email, concat('u', c_custkey % 20) AS owner, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_deleted FROM customer",
    "answers": "SELECT o_orderkey AS lec, concat('u', o_custkey) AS email FROM orders",
}
_WITH = "WITH " + ", ".join(f"{n} AS ({t})" for n, t in SITE.items()) + " "
_MINE = f"SELECT contactId FROM ContactInfo WHERE email = '{ME}'"

Q: dict = {}
SQL: dict = {}


def site(spark: SparkSession, sf_dir: str, email: str = ME) -> Site:
    base = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "lineitem")}
    fill = lambda text: text.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}")
    return Site({n: spark.sql(fill(t), **{k: v for k, v in base.items() if f"FROM {k}" in t}) for n, t in SITE.items()}, email)


def _add(name: str, table: str, key: str, where: str, cond) -> None:
    """The keys of a table's rows that the condition lets through, beside the same as nested SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = site(spark, sf_dir)
        return keep(s.tables[table], cond(s)).selectExpr(*key.split(", "))

    Q[name], SQL[name] = run, f"{_WITH}SELECT {key} FROM {table} WHERE {where}"


def _role(mask: int, alias: str = "c") -> str:
    return f"({alias}.roles & {mask}) <> 0"


_AUTHOR = f"""(EXISTS (SELECT 1 FROM Paper p1 WHERE p1.paperId = {{0}}.paperId AND lower(p1.authorInformation) LIKE '%{ME}%')
    OR EXISTS (SELECT 1 FROM PaperConflict pc JOIN ContactInfo c ON c.contactId = pc.contactId WHERE pc.paperId = {{0}}.paperId AND pc.conflictType >= 9 AND c.email = '{ME}'))"""
_MANAGER = f"EXISTS (SELECT 1 FROM Paper p JOIN ContactInfo c ON c.contactId = p.managerContactId WHERE p.paperId = {{0}}.paperId AND c.email = '{ME}')"
_SUBMITTED = "EXISTS (SELECT 1 FROM Paper p1 WHERE p1.paperId = {0}.paperId AND p1.timeSubmitted > 0 AND p1.timeWithdrawn <= 0)"


def _nonconflict(table: str, mask: int) -> str:
    return f"(NOT EXISTS (SELECT 1 FROM PaperConflict x JOIN ContactInfo c ON c.contactId = x.contactId WHERE x.paperId = {table}.paperId AND x.conflictType < 11 AND c.email = '{ME}') AND {_visitor(mask)})"


def _visitor(mask: int) -> str:
    return f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.email = '{ME}' AND {_role(mask)})"


_add("qp1_visitor_role", "TopicInterest", "contactId, topicId", _visitor(CHAIR | ADMIN), lambda s: S.visitor_role(s, CHAIR | ADMIN))
_add("qp1_visitor_lacks_role", "TopicInterest", "contactId, topicId", _visitor(CHAIR) + " OR topicId = 3", lambda s: S.visitor_role(s, CHAIR) | S.Cond("topicId = 3"))
_add("qp2_data_role", "ContactInfo", "contactId", _role(CHAIR | PC, "ContactInfo"), lambda s: S.data_role(s, CHAIR | PC))
_add("qp3_own_contact", "ContactInfo", "contactId", f"email = '{ME}'", S.own_contact)
_add("qp4_fellow_in_conflict", "ContactInfo", "contactId", f"contactId IN (SELECT contactId FROM PaperConflict WHERE conflictType >= 5 AND paperId IN (SELECT pc2.paperId FROM PaperConflict pc2 JOIN ContactInfo c ON c.contactId = pc2.contactId WHERE c.email = '{ME}' AND pc2.conflictType >= 5))", lambda s: S.fellow_in_conflict(s, 5))
_add("qp5_named_author", "ContactInfo", "contactId", "EXISTS (SELECT 1 FROM Paper WHERE instr(authorInformation, email) > 0 OR instr(authorInformation, concat(firstName, chr(9), lastName)) > 0)", S.named_author)
_add(
    "qp6_own_shepherd", "ContactInfo", "contactId",
    f"(roles & 63) <> 0 AND (EXISTS (SELECT 1 FROM Paper p WHERE p.shepherdContactId = ContactInfo.contactId AND lower(p.authorInformation) LIKE '%{ME}%') OR EXISTS (SELECT 1 FROM PaperConflict pc JOIN ContactInfo c ON c.contactId = pc.contactId JOIN Paper p1 ON p1.paperId = pc.paperId WHERE pc.conflictType >= 9 AND c.email = '{ME}' AND p1.shepherdContactId = ContactInfo.contactId))",
    lambda s: S.own_shepherd(s, 63),
)
_add("qp7_paper_author", "PaperReview", "reviewId", _AUTHOR.format("PaperReview"), S.paper_author)
_add("qp8_paper_manager", "PaperReview", "reviewId", _MANAGER.format("PaperReview"), S.paper_manager)
_add("qp9_rating_manager", "ReviewRating", "reviewId", f"EXISTS (SELECT 1 FROM PaperReview pr JOIN Paper p ON p.paperId = pr.paperId JOIN ContactInfo c ON c.contactId = p.managerContactId WHERE pr.reviewId = ReviewRating.reviewId AND c.email = '{ME}' AND {_role(PC | CHAIR)})", lambda s: S.rating_manager(s, PC | CHAIR))
_add("qp10_paper_submitted", "Paper", "paperId", "timeSubmitted > 0 AND timeWithdrawn <= 0", S.paper_submitted)
_add("qp11_submitted_paper", "PaperReview", "reviewId", _SUBMITTED.format("PaperReview"), S.submitted_paper)
_add("qp12_paper_accepted", "Paper", "paperId", "timeSubmitted > 0 AND timeWithdrawn <= 0 AND outcome > 0", S.paper_accepted)
_add("qp13_accepted_paper", "PaperReview", "reviewId", "EXISTS (SELECT 1 FROM Paper p1 WHERE p1.paperId = PaperReview.paperId AND p1.timeSubmitted > 0 AND p1.timeWithdrawn <= 0 AND p1.outcome > 0)", S.accepted_paper)
_add("qp14_nonconflict_role", "PaperTag", "paperId", _nonconflict("PaperTag", PC), lambda s: S.nonconflict_role(s, PC))
_add("qp15_rating_nonconflict_role", "ReviewRating", "reviewId", f"NOT EXISTS (SELECT 1 FROM PaperReview pr JOIN PaperConflict pc ON pc.paperId = pr.paperId JOIN ContactInfo c ON c.contactId = pc.contactId WHERE pr.reviewId = ReviewRating.reviewId AND c.email = '{ME}' AND {_role(PC)})", lambda s: S.rating_nonconflict_role(s, PC))
_add("qp16_conflict_role", "PaperConflict", "paperId, contactId", f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = PaperConflict.contactId AND c.email = '{ME}' AND {_role(PC)})", lambda s: S.conflict_role(s, PC))
_add("qp17_conflict_view", "PaperConflict", "paperId, contactId", "conflictType <= 8", S.conflict_view)
_add("qp18_author_conflict", "PaperConflict", "paperId, contactId", _AUTHOR.format("PaperConflict"), S.paper_author)
_add("qp19_requested_in_role", "ReviewRequest", "paperId, n", f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = ReviewRequest.requestedBy AND c.email = '{ME}' AND {_role(PC | CHAIR | ADMIN)})", lambda s: S.requested(s, PC | CHAIR | ADMIN))
_add("qp20_own_preference", "PaperReviewPreference", "paperId", f"EXISTS (SELECT 1 FROM PaperReviewPreference prp JOIN PaperReview pr ON pr.paperId = prp.paperId JOIN ContactInfo c ON c.contactId = prp.contactId WHERE prp.paperId = PaperReviewPreference.paperId AND c.email = '{ME}' AND {_role(PC)})", lambda s: S.own_preference(s, PC))
_add("qp21_review_submitted", "PaperReview", "reviewId", "reviewSubmitted > 0 AND reviewNeedsSubmit <= 0", S.review_submitted)
_add("qp22_requester", "PaperReview", "reviewId", f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = PaperReview.requestedBy AND c.email = '{ME}')", S.requested)
_add("qp23_submitted_review", "PaperTag", "paperId", f"EXISTS (SELECT 1 FROM PaperReview r JOIN ContactInfo c ON c.contactId = r.contactId WHERE r.paperId = PaperTag.paperId AND r.reviewSubmitted > 0 AND c.email = '{ME}' AND {_role(PC | REVIEWER)})", lambda s: S.submitted_review(s, PC | REVIEWER))
_add("qp24_rating_submitted_review", "ReviewRating", "reviewId", f"EXISTS (SELECT 1 FROM PaperReview r JOIN ContactInfo c ON c.contactId = r.contactId WHERE r.reviewId = ReviewRating.reviewId AND r.reviewSubmitted > 0 AND c.email = '{ME}' AND {_role(PC | REVIEWER)})", lambda s: S.rating_submitted_review(s, PC | REVIEWER))
_add("qp25_comment_is", "PaperComment", "commentId", "(commentType & 196608) <> 0 AND (commentType & 1) = 0", lambda s: S.comment_is(s, S.COMMENT_AUTHOR) & S.comment_is(s, S.COMMENT_DRAFT, negated=True))
_add("qp26_comment_ordinal", "PaperComment", "commentId", "authorOrdinal > 0 AND ordinal = 0", S.comment_ordinal)
_add("qp27_own_topic", "TopicInterest", "contactId, topicId", f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = TopicInterest.contactId AND c.email = '{ME}')", S.own_topic)
_OWN = "EXISTS (SELECT 1 FROM users u WHERE u.email = {0}.email AND (u.email = 'u7' OR u.owner = 'u7'))"
_add("q14_own_answers", "answers", "lec, email", _OWN.format("answers"), lambda s: S.own_or_admin(s.tables["users"], "u7", "u1"))
_add("q14_own_users", "users", "email", _OWN.format("users"), lambda s: S.own_or_admin(s.tables["users"], "u7", "u1"))
_add("q14_admin_answers", "answers", "lec, email", "EXISTS (SELECT 1 FROM users u WHERE u.email = answers.email AND (u.email = 'u7' OR u.owner = 'u7' OR u.is_deleted = 0))", lambda s: S.own_or_admin(s.tables["users"], "u7", "u7"))


# --- policies at a time ---

BEFORE, REVIEWING, DISCUSSING, NOTIFIED, AFTER = "2016-05-20 00:00:00", "2016-05-28 12:00:00", "2016-05-29 12:00:00", "2016-05-30 12:00:00", "2016-06-10 00:00:00"


def _policy(query: str, name: str, time: str, key: str, where: str, email: str = ME) -> None:
    """The keys that a policy lets through for the visitor at a time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return review_policies.visible(name, site(spark, sf_dir, email), time).selectExpr(*key.split(", "))

    Q[query], SQL[query] = run, f"{_WITH}SELECT {key} FROM {POLICIES[name].table} WHERE {where}".replace(ME, email)


STAFF, HEADS = PC | CHAIR | ADMIN, CHAIR | ADMIN
#: A visitor with no role of the committee's: contact 16 (roles 80).
GUEST = "u16@x.org"
_NAMED = "EXISTS (SELECT 1 FROM Paper WHERE instr(authorInformation, email) > 0 OR instr(authorInformation, concat(firstName, chr(9), lastName)) > 0)"
_FELLOW = f"contactId IN (SELECT contactId FROM PaperConflict WHERE conflictType >= 9 AND paperId IN (SELECT pc2.paperId FROM PaperConflict pc2 JOIN ContactInfo c ON c.contactId = pc2.contactId WHERE c.email = '{ME}' AND pc2.conflictType >= 9))"
_REVIEWED = f"EXISTS (SELECT 1 FROM PaperReview r JOIN ContactInfo c ON c.contactId = r.contactId WHERE r.paperId = {{0}}.paperId AND r.reviewSubmitted > 0 AND c.email = '{ME}' AND {_role(PC)})"
_REQUESTED = f"EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = {{0}}.requestedBy AND c.email = '{ME}')"
_COMMITTEE = f"({_visitor(PC)} AND (roles & 37) <> 0)"
_OPEN = "timeSubmitted > 0 AND timeWithdrawn <= 0"

_policy("q16_contact_info_guest", "contact_info", NOTIFIED, "contactId", f"{_visitor(HEADS)} OR email = '{ME}' OR {_FELLOW} OR {_COMMITTEE} OR (roles & 5) <> 0 OR ({_visitor(CHAIR | PC)} AND {_NAMED})", GUEST)
_policy("q16_contact_email_guest", "contact_email", BEFORE, "contactId", f"{_visitor(HEADS)} OR ({_visitor(CHAIR | PC)} AND (roles & 37) <> 0) OR email = '{ME}' OR {_FELLOW}", GUEST)
_policy("q16_contact_id_guest", "contact_id", AFTER, "contactId", f"{_visitor(STAFF)} OR email = '{ME}' OR (roles & 5) <> 0 OR {_FELLOW} OR ({_visitor(CHAIR | PC)} AND {_NAMED})", GUEST)
_policy("q16_paper_title_guest", "paper_title", NOTIFIED, "paperId", f"{_AUTHOR.format('Paper')} OR ({_visitor(STAFF)} AND {_OPEN})", GUEST)
_policy("q16_paper_title", "paper_title", NOTIFIED, "paperId", f"{_AUTHOR.format('Paper')} OR ({_visitor(STAFF)} AND {_OPEN})")
_policy("q16_paper_author_guest", "paper_author", NOTIFIED, "paperId", f"{_AUTHOR.format('Paper')} OR {_visitor(HEADS)} OR ({_visitor(STAFF)} AND {_OPEN} AND outcome > 0)", GUEST)
_policy("q16_paper_outcome", "paper_outcome", REVIEWING, "paperId", f"{_OPEN} AND ({_nonconflict('Paper', CHAIR | PC)} OR {_MANAGER.format('Paper')} OR {_visitor(ADMIN)})")
_policy("q16_paper_lead", "paper_lead", REVIEWING, "paperId", f"{_SUBMITTED.format('Paper')} AND ({_nonconflict('Paper', HEADS)} OR {_MANAGER.format('Paper')} OR ({_REVIEWED.format('Paper')} AND {_nonconflict('Paper', PC)}))")
_policy("q16_review_reviewing_guest", "review_for_author", REVIEWING, "reviewId", f"{_SUBMITTED.format('PaperReview')} AND ({_nonconflict('PaperReview', HEADS)} OR {_MANAGER.format('PaperReview')} OR ({_REVIEWED.format('PaperReview')} AND {_nonconflict('PaperReview', PC)}) OR {_REQUESTED.format('PaperReview')}) AND reviewSubmitted > 0 AND reviewNeedsSubmit <= 0", GUEST)
_policy("q16_review_discussing", "review_private", DISCUSSING, "reviewId", f"{_SUBMITTED.format('PaperReview')} AND ({_nonconflict('PaperReview', STAFF)} OR {_MANAGER.format('PaperReview')} OR {_REQUESTED.format('PaperReview')})")
_policy("q16_review_notified_guest", "review_for_author", NOTIFIED, "reviewId", f"({_SUBMITTED.format('PaperReview')} AND ({_nonconflict('PaperReview', STAFF)} OR {_MANAGER.format('PaperReview')} OR {_REQUESTED.format('PaperReview')})) OR (reviewSubmitted > 0 AND reviewNeedsSubmit <= 0 AND {_AUTHOR.format('PaperReview')})", GUEST)
_policy("q16_comment_notified_guest", "comment_for_author", NOTIFIED, "commentId", f"{_SUBMITTED.format('PaperComment')} AND (commentType & 1) = 0 AND ({_MANAGER.format('PaperComment')} OR {_nonconflict('PaperComment', STAFF)} OR ({_AUTHOR.format('PaperComment')} AND (commentType & 196608) <> 0 AND authorOrdinal > 0 AND ordinal = 0))", GUEST)
_policy("q16_conflict_guest", "conflict", BEFORE, "paperId, contactId", f"{_visitor(HEADS)} OR EXISTS (SELECT 1 FROM ContactInfo c WHERE c.contactId = PaperConflict.contactId AND c.email = '{ME}' AND {_role(PC)}) OR {_AUTHOR.format('PaperConflict')}", GUEST)
_policy("q16_preference", "review_preference", REVIEWING, "paperId", f"{_MANAGER.format('PaperReviewPreference')} OR {_nonconflict('PaperReviewPreference', HEADS)} OR (EXISTS (SELECT 1 FROM PaperReviewPreference prp JOIN PaperReview pr ON pr.paperId = prp.paperId JOIN ContactInfo c ON c.contactId = prp.contactId WHERE prp.paperId = PaperReviewPreference.paperId AND c.email = '{ME}' AND {_role(PC)}) AND {_nonconflict('PaperReviewPreference', PC)})")
_policy("q16_requests_guest", "review_request", BEFORE, "paperId, n", f"{_MANAGER.format('ReviewRequest')} OR {_visitor(HEADS)} OR ({_REQUESTED.format('ReviewRequest')} AND {_visitor(STAFF)})", GUEST)


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers counted by outcome under the weakest of the aggregate policies that cover the query, after the notification."""
    (name,) = policy.least_restrictive({"aggr_by_outcome", "aggr_by_topic", "aggr_by_topic_country"}, WEAKER)
    seen = review_policies.visible(name, site(spark, sf_dir, GUEST), NOTIFIED)
    return policy.run(spark, "select outcome, count(*) as n from Paper group by outcome", {"Paper": seen}, {})


Q["q16_aggregate_lattice"], SQL["q16_aggregate_lattice"] = _lattice, f"{_WITH}SELECT outcome, count(*) AS n FROM Paper GROUP BY outcome"


def _soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users are marked deleted, one of them is restored; the administrator sees the answers of all the others."""
    s = site(spark, sf_dir)
    users = update(update(s.tables["users"], "email IN ('u5', 'u8')", is_deleted="1"), "email = 'u5'", is_deleted="0")
    return keep(s.tables["answers"], S.own_or_admin(users, "u7", "u7")).select("lec", "email")


Q["q17_soft_delete"] = _soft_delete
SQL["q17_soft_delete"] = f"{_WITH}SELECT lec, email FROM answers WHERE EXISTS (SELECT 1 FROM users u WHERE u.email = answers.email AND (u.email = 'u7' OR u.owner = 'u7' OR u.email = 'u5' OR (u.is_deleted = 0 AND u.email <> 'u8')))"

QUERIES, ORACLES = Q, SQL
