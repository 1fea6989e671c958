"""Explicit schemas of the study tables and of the scraped post JSON."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampNTZType)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, L, I, T = StringType(), LongType(), IntegerType(), TimestampNTZType()

USER = _s(("id", L), ("username", S), ("email", S), ("type", S), ("createdAt", T), ("updatedAt", T),
          ("createdBy", S), ("updatedBy", S))
STUDY = _s(("id", L), ("name", S), ("obs", S), ("addedBy", S), ("startedAt", T), ("updatedBy", S),
           ("finishedAt", T), ("createdAt", T), ("updatedAt", T), ("minClassificationsPerPost", I),
           ("maxClassificationsPerUser", I), ("validationAgreementPercent", I))
USER_STUDY = _s(("userId", L), ("studyId", L))
POST = _s(("id", L), ("pageName", S), ("pageLink", S), ("postLink", S), ("postId", S), ("details", S),
          ("likesCount", L), ("commentsCount", L), ("sharesCount", L), ("isRetweet", I), ("socialName", S),
          ("studyId", L), ("createdAt", T))
IMAGE = _s(("imageId", L), ("postId", L), ("image_data", BinaryType()), ("isFrontPage", I))
QUESTION = _s(("id", L), ("question", S), ("content", S), ("inputType", S), ("studyId", L), ("createdAt", T))
CATEGORIES = _s(("id", L), ("name", S), ("categoryType", S), ("questionId", L), ("createdAt", T))
CLASSIFICATION = _s(("userId", L), ("postId", L), ("questionId", L), ("categoryId", L), ("createdAt", T))
SUBMISSION = _s(("submissionId", L), ("userId", L), ("postId", L), ("questionId", L),
                ("categoryIds", ArrayType(L)), ("sentimentoCategoryIds", ArrayType(L)), ("createdAt", T))

TABLES = {"user": USER, "study": STUDY, "user_study": USER_STUDY, "post": POST, "image": IMAGE,
          "question": QUESTION, "categories": CATEGORIES, "classification": CLASSIFICATION}

# Scraped tweet objects (one JSON array per file, or JSON lines).
TWEET_USER = _s(("avatar", S), ("username", S), ("userFullName", S), ("description", S), ("location", S),
                ("website", S), ("joinDate", S), ("verified", BooleanType()), ("totalLikes", L),
                ("totalTweets", L), ("totalFollowing", L), ("totalFollowers", L), ("url", S), ("userId", S))
TWEET = StructType([
    StructField("id", S), StructField("url", S), StructField("username", S), StructField("fullname", S),
    StructField("verified", BooleanType()), StructField("isPinned", BooleanType()),
    StructField("isQuote", BooleanType()), StructField("isRetweet", BooleanType()),
    StructField("isReply", BooleanType()), StructField("timestamp", S), StructField("text", S),
    StructField("links", ArrayType(S)), StructField("images", ArrayType(S)),
    StructField("replyingTo", ArrayType(S)), StructField("likes", L), StructField("replies", L),
    StructField("retweets", L), StructField("quotes", L), StructField("user", TWEET_USER),
    StructField("totalMediaCount", L), StructField("_corrupt_record", S),
])
