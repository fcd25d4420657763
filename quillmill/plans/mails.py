"""The mail flow: raw mails to dated, categorised mails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import mail as M
from quillmill.operators.tables import left_join_category


def date_mails(raw: DataFrame) -> DataFrame:
    """``Date`` parsed and split into Indian day and time; ``domain`` of the sender."""
    stamp = M.to_india_time(M.parse_mail_date(M.strip_gmt_suffix("Date")))
    return (
        raw.withColumn("datetime_ist", stamp)
        .withColumns(
            {
                "only_Date": M.date_part_string("datetime_ist"),
                "only_time": M.time_part_string("datetime_ist"),
                "domain": M.mail_domain("From"),
            }
        )
        .drop("Date")
    )


def mail_prepare(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Dated mails with the label of their domain, nulls filled."""
    dated = date_mails(raw).withColumn(
        "datetime_ist", F.date_format("datetime_ist", "yyyy-MM-dd HH:mm:ss")
    )
    return left_join_category(dated, categories)
