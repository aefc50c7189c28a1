"""The review site's policies: for each a table and clauses, each open in a phase of the conference, which are ORed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cloakwork.operators import review_site as S
from cloakwork.operators.conditions import ALWAYS, Cond, keep
from cloakwork.operators.review_site import ADMIN, ANALYST, CHAIR, PC, REVIEWER, Site, any_of


@dataclass(frozen=True)
class Phases:
    """When a conference's phases begin; any ordered values do. The defaults are fixed values."""

    submitted: str = "2016-05-26 08:00:00"
    reviewing: str = "2016-05-28 08:00:00"
    discussing: str = "2016-05-29 08:00:00"
    notified: str = "2016-05-30 08:00:00"
    held: str = "2016-05-31 08:00:00"


@dataclass(frozen=True)
class Clause:
    """Rows that ``cond`` lets through from phase ``since`` (``after``: strictly later) until ``until`` begins.

    A clause that isn't ``public`` asks for a visitor who is signed in.
    """

    cond: Callable[[Site], Cond]
    since: str | None = None
    until: str | None = None
    after: str | None = None
    public: bool = False

    def open(self, time: str, phases: Phases, signed_in: bool) -> bool:
        at = lambda p: getattr(phases, p)
        late = (not self.since or time >= at(self.since)) and (not self.after or time > at(self.after))
        return late and (not self.until or time < at(self.until)) and (self.public or signed_in)


@dataclass(frozen=True)
class SitePolicy:
    table: str
    clauses: tuple[Clause, ...]
    aggregate: bool = False


_STAFF, _HEADS, _ANALYSTS = CHAIR | PC | ADMIN, CHAIR | ADMIN, CHAIR | ANALYST | ADMIN


def role(mask: int) -> Callable[[Site], Cond]:
    return lambda s: S.visitor_role(s, mask)


def _everyone(s: Site) -> Cond:
    return ALWAYS


def _author_or_heads(s: Site) -> Cond:
    return S.paper_author(s) | S.visitor_role(s, _HEADS)


def _staff_or_manager(s: Site) -> Cond:
    return S.visitor_role(s, _STAFF) | S.paper_manager(s)


def _unconflicted_or_manager(mask: int) -> Callable[[Site], Cond]:
    return lambda s: S.nonconflict_role(s, mask) | S.paper_manager(s)


def _both(*conds: Callable[[Site], Cond]) -> Callable[[Site], Cond]:
    def all_of(s: Site) -> Cond:
        out = conds[0](s)
        for c in conds[1:]:
            out = out & c(s)
        return out

    return all_of


def _contact_full(s: Site) -> Cond:
    committee = S.visitor_role(s, CHAIR | PC) & S.data_role(s, CHAIR | PC | REVIEWER)
    return any_of(S.visitor_role(s, _HEADS), committee, S.own_contact(s), S.fellow_in_conflict(s))


def _contact_seen(s: Site) -> Cond:
    committee = S.visitor_role(s, PC) & S.data_role(s, CHAIR | PC | REVIEWER)
    return any_of(S.visitor_role(s, _HEADS), S.own_contact(s), S.fellow_in_conflict(s), committee)


def _pc_view(s: Site) -> Cond:
    return any_of(S.own_contact(s), S.visitor_role(s, PC) & S.data_role(s, CHAIR | PC | REVIEWER), S.visitor_role(s, _HEADS))


def _reviewing(on_reviews: bool) -> Callable[[Site], Cond]:
    """While reviews are written: who has handed one in sees the others, requesters see what they asked for."""

    def cond(s: Site) -> Cond:
        who = any_of(S.nonconflict_role(s, _HEADS), S.paper_manager(s), S.submitted_review(s, PC) & S.nonconflict_role(s, PC))
        if on_reviews:
            return S.submitted_paper(s) & (who | S.requested(s)) & S.review_submitted(s)
        return S.submitted_paper(s) & who

    return cond


def _discussing(s: Site) -> Cond:
    return S.submitted_paper(s) & any_of(S.nonconflict_role(s, _STAFF), S.paper_manager(s), S.requested(s))


def _final_comment(s: Site) -> Cond:
    return S.submitted_paper(s) & S.comment_is(s, S.COMMENT_DRAFT, negated=True)


def _comment_reviewing(s: Site) -> Cond:
    reviewer = S.submitted_review(s, PC) & S.nonconflict_role(s, PC) & S.comment_is(s, S.COMMENT_PCONLY)
    return _final_comment(s) & any_of(S.paper_manager(s), S.nonconflict_role(s, _HEADS), reviewer)


def _comment_for_author(s: Site) -> Cond:
    return _final_comment(s) & S.paper_author(s) & S.comment_is(s, S.COMMENT_AUTHOR) & S.comment_ordinal(s)


def _rating_reviewing(s: Site) -> Cond:
    own = S.rating_submitted_review(s, PC) & S.rating_nonconflict_role(s, PC)
    return any_of(S.rating_nonconflict_role(s, _HEADS), S.rating_manager(s, _HEADS), own)


_TITLE = (Clause(S.paper_author), Clause(role(_STAFF), until="submitted"), Clause(_both(role(_STAFF), S.paper_submitted), since="submitted"))
_AUTHORS = (Clause(_author_or_heads), Clause(_both(role(_STAFF), S.paper_accepted), since="notified"))
_META = (Clause(_author_or_heads), Clause(_both(role(_STAFF), S.submitted_paper), since="submitted"))
_ANALYTICS = (Clause(role(_ANALYSTS), since="held"),)
_PUBLIC_LATER = Clause(_everyone, since="held")
_REVIEWS = (Clause(_reviewing(True), since="reviewing", until="discussing"), Clause(_discussing, since="discussing"))
_COMMENTS = (Clause(_comment_reviewing, since="reviewing", until="discussing"), Clause(_both(_final_comment, _unconflicted_or_manager(_STAFF)), since="discussing"))
_REQUESTS = (Clause(lambda s: any_of(S.paper_manager(s), S.visitor_role(s, _HEADS), S.requested(s, _STAFF))),)
_OPEN_PAPER = S.paper_submitted

POLICIES: dict[str, SitePolicy] = {
    "false": SitePolicy("Paper", ()),
    "true": SitePolicy("Paper", (Clause(_everyone, public=True),)),
    "contact_info": SitePolicy(
        "ContactInfo",
        (
            Clause(_contact_seen),
            Clause(lambda s: S.data_role(s, CHAIR | PC), public=True),
            Clause(lambda s: S.data_role(s, REVIEWER), after="held", public=True),
            Clause(_both(role(CHAIR | PC), S.named_author), after="notified"),
        ),
    ),
    "contact_email": SitePolicy("ContactInfo", (Clause(_contact_full), Clause(lambda s: S.own_shepherd(s, CHAIR | PC) | (S.visitor_role(s, CHAIR | PC) & S.named_author(s)), after="notified"))),
    "contact_id": SitePolicy(
        "ContactInfo",
        (Clause(lambda s: any_of(S.visitor_role(s, _STAFF), S.own_contact(s), S.data_role(s, CHAIR | PC), S.fellow_in_conflict(s))), Clause(_both(role(CHAIR | PC), S.named_author), after="notified")),
    ),
    "contact_pc_view": SitePolicy("ContactInfo", (Clause(_pc_view),)),
    "contact_private": SitePolicy("ContactInfo", (Clause(S.own_contact),)),
    "contact_chair_owner": SitePolicy("ContactInfo", (Clause(lambda s: S.own_contact(s) | S.visitor_role(s, _HEADS)),)),
    "paper_title": SitePolicy("Paper", _TITLE),
    "paper_author": SitePolicy("Paper", _AUTHORS),
    "paper_title_author": SitePolicy("Paper", _AUTHORS),
    "paper_title_topic": SitePolicy("Paper", (*_TITLE, _PUBLIC_LATER)),
    "paper_author_affil": SitePolicy("Paper", (*_AUTHORS, _PUBLIC_LATER)),
    "paper_outcome": SitePolicy(
        "Paper",
        (
            Clause(lambda s: S.paper_author(s) | (S.visitor_role(s, _STAFF) & _OPEN_PAPER(s)), since="notified"),
            Clause(lambda s: _OPEN_PAPER(s) & any_of(S.nonconflict_role(s, CHAIR | PC), S.paper_manager(s), S.visitor_role(s, ADMIN))),
        ),
    ),
    "paper_shepherd": SitePolicy(
        "Paper", (Clause(S.paper_author, since="notified"), Clause(lambda s: _OPEN_PAPER(s) & any_of(S.nonconflict_role(s, PC), S.paper_manager(s), S.visitor_role(s, _HEADS))))
    ),
    "paper_lead": SitePolicy("Paper", (Clause(_reviewing(False), since="reviewing", until="discussing"), Clause(_both(_OPEN_PAPER, _unconflicted_or_manager(_STAFF)), since="discussing"))),
    "paper_manager": SitePolicy("Paper", (Clause(lambda s: _OPEN_PAPER(s) & any_of(S.nonconflict_role(s, PC), S.paper_manager(s), S.visitor_role(s, _HEADS))),)),
    "paper_meta": SitePolicy("Paper", _META),
    "aggr_by_outcome": SitePolicy("Paper", (Clause(_everyone, since="notified", public=True),), True),
    "aggr_by_topic": SitePolicy("Paper", _ANALYTICS, True),
    "aggr_by_affil": SitePolicy("Paper", _ANALYTICS, True),
    "aggr_by_topic_country": SitePolicy("Paper", _ANALYTICS, True),
    "storage": SitePolicy("PaperStorage", _META),
    "review_for_author": SitePolicy("PaperReview", (*_REVIEWS, Clause(_both(S.review_submitted, S.paper_author), since="notified"))),
    "review_private": SitePolicy("PaperReview", _REVIEWS),
    "aggr_review_status": SitePolicy("PaperReview", (Clause(_both(S.submitted_paper, _unconflicted_or_manager(_STAFF)), since="reviewing"),), True),
    "avg_merit": SitePolicy("PaperReview", (Clause(_both(S.submitted_paper, _staff_or_manager), since="reviewing"),), True),
    "review_analytics": SitePolicy("PaperReview", _ANALYTICS, True),
    "review_aggr_by_topic": SitePolicy("PaperReview", _ANALYTICS, True),
    "review_aggr_by_affil": SitePolicy("PaperReview", _ANALYTICS, True),
    "review_rating": SitePolicy(
        "ReviewRating",
        (
            Clause(_rating_reviewing, since="reviewing", until="discussing"),
            Clause(lambda s: S.rating_nonconflict_role(s, _STAFF) | S.rating_manager(s, _STAFF), since="discussing"),
        ),
    ),
    "conflict": SitePolicy("PaperConflict", (Clause(lambda s: any_of(S.visitor_role(s, _HEADS), S.conflict_role(s, PC), S.paper_author(s))), Clause(role(_STAFF), after="notified"))),
    "paper_tags": SitePolicy("PaperTag", (Clause(_staff_or_manager),)),
    "paper_options": SitePolicy("PaperOption", (Clause(lambda s: _staff_or_manager(s) | S.paper_author(s)),)),
    "comment_for_author": SitePolicy("PaperComment", (*_COMMENTS, Clause(_comment_for_author, since="notified"))),
    "comment_private": SitePolicy("PaperComment", _COMMENTS),
    "comment_id": SitePolicy("PaperComment", (Clause(_staff_or_manager),)),
    "comment_paper": SitePolicy("PaperComment", (Clause(lambda s: S.paper_author(s) | (_staff_or_manager(s) & S.submitted_paper(s))),)),
    "topic_interest": SitePolicy("TopicInterest", (Clause(lambda s: S.visitor_role(s, _HEADS) | S.own_topic(s)),)),
    "paper_topic": SitePolicy("PaperTopic", (Clause(lambda s: S.paper_author(s) | (S.submitted_paper(s) & S.visitor_role(s, _STAFF))),)),
    "action_log": SitePolicy("ActionLog", (Clause(_unconflicted_or_manager(_HEADS)),)),
    "mail_log": SitePolicy("MailLog", (Clause(role(_HEADS)),)),
    "review_request": SitePolicy("ReviewRequest", _REQUESTS),
    "review_refused": SitePolicy("PaperReviewRefused", _REQUESTS),
    "review_preference": SitePolicy(
        "PaperReviewPreference", (Clause(lambda s: any_of(S.paper_manager(s), S.nonconflict_role(s, _HEADS), S.own_preference(s, PC) & S.nonconflict_role(s, PC))),)
    ),
    "paper_watch": SitePolicy("PaperWatch", (Clause(role(_STAFF)),)),
}

#: Which aggregate policies each is weaker than, for `policy.least_restrictive`.
WEAKER = {
    "aggr_by_outcome": {"aggr_by_topic", "aggr_by_affil", "aggr_by_topic_country", "review_aggr_by_topic", "review_aggr_by_affil"},
    "aggr_by_topic": {"aggr_by_topic_country", "review_aggr_by_topic"},
    "aggr_by_affil": {"review_aggr_by_affil"},
    "avg_merit": {"combined_stats"},
}


def condition(name: str, site: Site, time: str, phases: Phases = Phases()) -> Cond:
    """The clauses open at this time ORed; none lets no row through."""
    return any_of(*[c.cond(site) for c in POLICIES[name].clauses if c.open(time, phases, bool(site.email))])


def visible(name: str, site: Site, time: str, phases: Phases = Phases()) -> DataFrame:
    """The rows of the policy's table that the visitor may see at this time."""
    return keep(site.tables[POLICIES[name].table], condition(name, site, time, phases))
