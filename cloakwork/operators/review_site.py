"""Predicates and policies of a conference's review site: who may see which rows, as key sets instead of nested queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.conditions import ALWAYS, NEVER, Cond, containing, keep, member

# Fixed values of the site's data: role bits, conflict degrees, comment bits.
PC, ADMIN, CHAIR, PCLIKE, AUTHOR, REVIEWER, ANALYST = 1, 2, 4, 15, 16, 32, 64
CONFLICT_AUTHORMARK, CONFLICT_MAXAUTHORMARK, CONFLICT_CHAIRMARK, CONFLICT_AUTHOR, CONFLICT_CONTACTAUTHOR, CONFLICT_MAX = 2, 7, 8, 9, 10, 11
COMMENT_DRAFT, COMMENT_PCONLY, COMMENT_AUTHOR = 1, 0x10000, 0x30000

SUBMITTED = "timeSubmitted > 0 AND timeWithdrawn <= 0"


@dataclass(frozen=True)
class Site:
    """The site's tables by name, and the visitor's address."""

    tables: dict[str, DataFrame]
    email: str

    def me(self, mask: int | None = None) -> DataFrame:
        """The visitor's contact ids, if a mask is given those with one of its roles."""
        c = self.tables["ContactInfo"].where(F.col("email") == self.email)
        return (c if mask is None else c.where(F.col("roles").bitwiseAND(mask) != 0)).select("contactId")

    def papers_in_conflict(self, where: str, mask: int | None = None) -> DataFrame:
        return self.tables["PaperConflict"].where(where).join(self.me(mask), "contactId", "left_semi").select("paperId")

    @cached_property
    def written(self) -> DataFrame:
        """Papers that name the visitor among their authors, or that the visitor is marked an author of."""
        named = self.tables["Paper"].where(F.contains(F.lower("authorInformation"), F.lit(self.email.lower()))).select("paperId")
        return named.union(self.papers_in_conflict(f"conflictType >= {CONFLICT_AUTHOR}"))

    def managed(self, mask: int | None = None) -> DataFrame:
        p = self.tables["Paper"].select("paperId", F.col("managerContactId").alias("contactId"))
        return p.join(self.me(mask), "contactId", "left_semi").select("paperId")

    def own_reviews(self, mask: int) -> DataFrame:
        return self.tables["PaperReview"].where("reviewSubmitted > 0").join(self.me(mask), "contactId", "left_semi")

    def reviews_of(self, papers: DataFrame) -> DataFrame:
        return self.tables["PaperReview"].join(papers, "paperId", "left_semi").select("reviewId")


# --- the visitor ---


def visitor_role(s: Site, mask: int) -> Cond:
    """The visitor has one of the roles (AUTHOR: none at all). One look-up that answers yes or no for all rows."""
    c = s.tables["ContactInfo"].where(F.col("email") == s.email)
    has = c.where("roles = 0") if mask == AUTHOR else c.where(F.col("roles").bitwiseAND(mask) != 0)
    return NEVER if has.isEmpty() else ALWAYS


# --- contacts ---


def data_role(s: Site, mask: int) -> Cond:
    return Cond(f"roles & {mask} <> 0")


def own_contact(s: Site) -> Cond:
    return Cond("email = '" + s.email.replace("\\", "\\\\").replace("'", "\\'") + "'")


def fellow_in_conflict(s: Site, least: int = CONFLICT_AUTHOR) -> Cond:
    """Contacts with a conflict of this degree on a paper that the visitor has one on, too."""
    degree = f"conflictType >= {least}"
    return member("contactId", s.tables["PaperConflict"].where(degree).join(s.papers_in_conflict(degree), "paperId", "left_semi").select("contactId"))


def named_author(s: Site) -> Cond:
    """Contacts whose address, or first and last name, stands in some paper's list of authors."""
    c = s.tables["ContactInfo"].select("contactId", "email", F.expr("firstName || '\\t' || lastName").alias("name"))
    found = [containing(s.tables["Paper"], "authorInformation", c, "contactId", x) for x in ("email", "name")]
    return member("contactId", found[0].union(found[1]))


def own_shepherd(s: Site, mask: int) -> Cond:
    """Contacts with the role who shepherd a paper of the visitor's."""
    return member("contactId", s.tables["Paper"].join(s.written, "paperId", "left_semi").select("shepherdContactId")) & data_role(s, mask)


# --- any table with a paperId ---


def paper_author(s: Site) -> Cond:
    return member("paperId", s.written)


def paper_manager(s: Site) -> Cond:
    return member("paperId", s.managed())


def submitted_paper(s: Site) -> Cond:
    return member("paperId", s.tables["Paper"].where(SUBMITTED).select("paperId"))


def accepted_paper(s: Site) -> Cond:
    return member("paperId", s.tables["Paper"].where(f"{SUBMITTED} AND outcome > 0").select("paperId"))


def nonconflict_role(s: Site, mask: int, below: int = CONFLICT_MAX) -> Cond:
    """The visitor has the role and no conflict of a degree below this one with the row's paper."""
    return ~member("paperId", s.papers_in_conflict(f"conflictType < {below}")) & visitor_role(s, mask)


def submitted_review(s: Site, mask: int) -> Cond:
    """The visitor, in the role, has submitted a review of the row's paper."""
    return member("paperId", s.own_reviews(mask).select("paperId"))


# --- papers ---


def paper_submitted(s: Site) -> Cond:
    return Cond(SUBMITTED)


def paper_accepted(s: Site) -> Cond:
    return Cond(f"{SUBMITTED} AND outcome > 0")


# --- conflicts, preferences, requests ---


def conflict_role(s: Site, mask: int) -> Cond:
    """The conflict is the visitor's own, in the role."""
    return member("contactId", s.me(mask))


def conflict_view(s: Site, most: int = CONFLICT_CHAIRMARK) -> Cond:
    return Cond(f"conflictType <= {most}")


def requested(s: Site, mask: int | None = None) -> Cond:
    """The visitor (in the role, if one is given) asked for this review."""
    return member("requestedBy", s.me(mask))


def own_preference(s: Site, mask: int) -> Cond:
    """Papers that are reviewed and that the visitor, in the role, has a preference for."""
    mine = s.tables["PaperReviewPreference"].join(s.me(mask), "contactId", "left_semi")
    return member("paperId", mine.join(s.tables["PaperReview"], "paperId", "left_semi").select("paperId"))


def own_topic(s: Site) -> Cond:
    return member("contactId", s.me())


# --- reviews, ratings, comments ---


def review_submitted(s: Site) -> Cond:
    return Cond("reviewSubmitted > 0 AND reviewNeedsSubmit <= 0")


def rating_manager(s: Site, mask: int) -> Cond:
    return member("reviewId", s.reviews_of(s.managed(mask)))


def rating_nonconflict_role(s: Site, mask: int) -> Cond:
    """No conflict of the visitor's, in the role, with the rated review's paper."""
    return ~member("reviewId", s.reviews_of(s.papers_in_conflict("true", mask)))


def rating_submitted_review(s: Site, mask: int) -> Cond:
    return member("reviewId", s.own_reviews(mask).select("reviewId"))


def comment_is(s: Site, bits: int, negated: bool = False) -> Cond:
    return Cond(f"commentType & {bits} {'=' if negated else '<>'} 0")


def comment_ordinal(s: Site) -> Cond:
    return Cond("authorOrdinal > 0 AND ordinal = 0")


# --- a site for homework: users and their answers ---


def own_or_admin(users: DataFrame, me: str, admin: str) -> Cond:
    """Rows of the visitor and of the visitor's pseudonyms; the administrator sees all users that aren't deleted."""
    own = (F.col("email") == me) | (F.col("owner") == me)
    return member("email", users.where(own | (F.col("is_deleted") == 0) if me == admin else own).select("email"))


def any_of(*conds: Cond) -> Cond:
    return reduce(lambda a, b: a | b, conds, NEVER)


__all__ = ["Site", "any_of", "keep"]
