"""What makes two records of an entity the same: rules as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import standardize as S

Key = Callable[[], Column]


@dataclass(frozen=True)
class EntityRule:
    """blocking: derived key columns; reads: the columns these are derived from; compared:
    fields of the similarity; required: must not be NULL; identity: key of the golden
    record; gold_columns: its columns, None for all."""

    name: str
    blocking: tuple[tuple[str, Key], ...]
    compared: tuple[str, ...]
    required: tuple[str, ...]
    identity: tuple[str, ...]
    id_column: str | None = None
    gold_columns: tuple[str, ...] | None = None
    derived: tuple[tuple[str, Key], ...] = ()
    reads: tuple[str, ...] = ()

    @property
    def block_columns(self) -> list[str]:
        return [n for n, _ in self.blocking]

    def with_blocks(self, df: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
        """``df`` with derived and blocking columns, without those named in ``leave_out``."""
        for n, key in self.derived:
            df = df.withColumn(n, key())
        return df.withColumns({n: key() for n, key in self.blocking if n not in leave_out})


def column(name: str) -> Key:
    return lambda: F.col(name)


def sounds(name: str) -> Key:
    return lambda: F.soundex(name)


# The fields by which the five entities are blocked, compared, required and identified.
RULES: dict[str, EntityRule] = {
    r.name: r
    for r in (
        EntityRule(
            name="customer",
            reads=("date_of_birth", "phone", "first_name", "last_name"),
            derived=(("norm_phone", lambda: S.digits(F.col("phone"))),),
            blocking=(
                ("blocking_dob", column("date_of_birth")),
                ("blocking_phone_prefix", lambda: S.prefix(F.col("norm_phone"), 5)),
                ("blocking_fname", sounds("first_name")),
                ("blocking_lname", sounds("last_name")),
            ),
            compared=("first_name", "last_name", "email", "phone"),
            required=("customer_id", "email", "phone"),
            identity=("first_name", "last_name"),
            id_column="customer_id",
            gold_columns=("customer_id", "first_name", "last_name", "date_of_birth", "phone", "email", "address_line1", "address_line2", "city", "state", "postal_code", "source_system", "created_ts"),
        ),
        EntityRule(
            name="account",
            reads=("account_name", "account_group"),
            blocking=(("blocking_account", sounds("account_name")), ("blocking_group", column("account_group"))),
            compared=("account_name", "account_group", "account_owner", "account_code"),
            required=("account_id", "account_name"),
            identity=("account_name",),
            id_column="account_id",
        ),
        EntityRule(
            name="address",
            reads=("postal_code", "city", "state"),
            blocking=(("blocking_postal", column("postal_code")), ("blocking_city", sounds("city")), ("blocking_state", column("state"))),
            compared=("city", "state", "postal_code", "address_line1", "address_line2"),
            required=("postal_code", "city", "state"),
            identity=("postal_code", "city", "state", "address_line1", "address_line2"),
        ),
        EntityRule(
            name="transactions",
            reads=("amount", "currency", "transaction_date"),
            blocking=(("blocking_amount", column("amount")), ("blocking_currency", column("currency")), ("blocking_date", lambda: F.to_date("transaction_date"))),
            compared=("account_id", "transaction_type", "customer_id", "source_system", "invoice_code", "document_number", "opportunity_id", "opportunity_stage", "campaign_id"),
            required=("transaction_id", "amount", "currency"),
            identity=("account_id", "amount", "currency", "transaction_date"),
            id_column="transaction_id",
        ),
        EntityRule(
            name="contacts",
            reads=("contact_value",),
            blocking=(("blocking_contact", sounds("contact_value")),),
            compared=("contact_value", "contact_type", "source_system", "created_ts"),
            required=("contact_id", "contact_value"),
            identity=("contact_value", "contact_type"),
            id_column="contact_id",
        ),
    )
}

#: The two-source draft of the customer rule.
DRAFT_CUSTOMER = EntityRule(
    name="customer_draft",
    blocking=(
        ("blocking_email", lambda: S.email_domain(F.col("email"))),
        ("blocking_phone", lambda: S.prefix(F.col("phone"), 3)),
        ("blocking_name", sounds("first_name")),
    ),
    compared=("first_name", "email", "phone", "customer_id"),
    required=("customer_id", "email", "phone"),
    identity=("first_name", "last_name"),
    id_column="customer_id",
)


def survivorship_order(rule: EntityRule, columns: list[str], strict_compat: bool = False) -> list[Column]:
    """Source priority, newest first, then the id and all compared fields, so that the order is total."""
    order = [S.source_rank(F.col("source_system"), strict_compat=strict_compat).asc(), F.col("created_ts").desc_nulls_last()]
    rest = [c for c in dict.fromkeys([rule.id_column, *rule.identity, *rule.compared]) if c in columns and c not in ("source_system", "created_ts")]
    return order + [F.col(c).asc_nulls_last() for c in rest]
