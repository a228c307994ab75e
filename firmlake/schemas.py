"""Table schemas, the accounts tag dictionary, and conforming a frame to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
RATIO = T.DecimalType(10, 4)
SCORE = T.DecimalType(3, 2)

# Accounts column -> tags that may carry it, best first.
MONEY_TAGS = {
    "turnover": ["turnoverrevenue", "turnovergrossoperatingrevenue"],
    "profit_loss": ["profitloss"],
    "cash_bank_on_hand": ["cashbankonhand", "cashbankinhand"],
    "total_assets": ["totalassets"],
    "total_liabilities": ["totalliabilities"],
    "net_assets_liabilities": ["netassetsliabilities", "netassetsliabilitiesincludingpensionassetliability"],
    "fixed_assets": ["fixedassets"],
    "current_assets": ["currentassets"],
    "distribution_costs": ["distributioncosts"],
    "administrative_expenses": ["administrativeexpenses"],
    "other_operating_income": ["OtherOperatingIncome"],
    "cost_sales": ["costsales"],
    "gross_profit_loss": ["grossprofitloss"],
    "creditors": ["creditors"],
    "net_current_assets_liabilities": ["netcurrentassetsliabilities"],
    "total_assets_less_current_liabilities": ["totalassetslesscurrentliabilities"],
    "staff_costs_employee_benefits_expense": ["staffcostsemployeebenefitsexpense"],
    "wages_salaries": ["wagessalaries"],
    "operating_profit_loss": ["operatingprofitloss"],
    "net_finance_income_costs": ["netfinanceincomecosts"],
    "profit_loss_on_ordinary_activities_before_tax": ["profitlossonordinaryactivitiesbeforetax"],
    "profit_loss_on_ordinary_activities_after_tax": ["profitlossonordinaryactivitiesaftertax"],
    "investments_fixed_assets": ["investmentsfixedassets"],
    "debtors": ["debtors"],
    "total_inventories": ["totalinventories"],
    "trade_creditors_trade_payables": ["tradecreditorstradepayables"],
    "bank_borrowings_overdrafts": ["bankborrowingsoverdrafts"],
    "current_liabilities": ["currentliabilities", "AccruedLiabilities"],
    "income_expense_recognised_directly_in_equity": ["incomeexpenserecogniseddirectlyinequity"],
    "dividends_paid": ["dividendspaid"],
    "net_cash_flows_from_used_in_operating_activities": ["netcashflowsfromusedinoperatingactivities"],
    "net_cash_generated_from_operations": ["netcashgeneratedfromoperations"],
    "income_taxes_paid_refund_classified_as_operating_activities": [
        "incometaxespaidrefundclassifiedasoperatingactivities"
    ],
    "net_cash_flows_from_used_in_investing_activities": ["netcashflowsfromusedininvestingactivities"],
    "net_cash_flows_from_used_in_financing_activities": ["netcashflowsfromusedinfinancingactivities"],
    "cash_cash_equivalents_cash_flow_value": ["cashcashequivalentscashflowvalue"],
    "social_security_costs": ["socialsecuritycosts"],
    "other_employee_expense": ["otheremployeeexpense"],
    "director_remuneration": ["directorremuneration"],
}
COUNT_TAGS = {
    "average_number_employees_during_period": ["averagenumberemployeesduringperiod"],
    "administration_support_average_number_employees": ["administrationsupportaveragenumberemployees"],
    "production_average_number_employees": ["productionaveragenumberemployees"],
    "sales_marketing_distribution_average_number_employees": ["salesmarketingdistributionaveragenumberemployees"],
    "other_departments_average_number_employees": ["otherdepartmentsaveragenumberemployees"],
}
TEXT_TAGS = {
    "period_start": ["startdateforperiodcoveredbyreport"],
    "description_body_authorising_financial_statements": ["descriptionbodyauthorisingfinancialstatements"],
    "production_software_name": ["nameProductionSoftware"],
    "production_software_version": ["versionProductionSoftware"],
    "report_title": ["reportTitle"],
    "entity_current_legal_or_registered_name": ["entityCurrentLegalOrRegisteredName"],
    "name_entity_officer": ["nameEntityOfficer"],
    "entity_trading_status": ["entityTradingStatus"],
}
TAG_DICTIONARY = {**MONEY_TAGS, **COUNT_TAGS, **TEXT_TAGS}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _L, _B, _TS = (
    T.StringType(), T.DateType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType(),
)

LINEAGE = dict(
    data_hash=_S, change_detected=_B, last_updated=_TS, merged_at=_TS, batch_id=_S, ingested_at=_TS,
    needs_review=_B, review_notes=_S,
)

COMPANY_DATA = _struct(
    company_number=_S, company_name=_S, company_status=_S, company_type=_S, locality=_S, postal_code=_S,
    address_line_1=_S, address_line_2=_S, region=_S, country=_S, sic_codes=T.ArrayType(_S),
    incorporation_date=_D, accounts_last_made_up_date=_D, accounts_ref_date=_S, accounts_next_due_date=_D,
    account_category=_S, returns_next_due_date=_D, returns_last_made_up_date=_D, num_mort_charges=_I,
    num_mort_outstanding=_I, num_mort_part_satisfied=_I, previous_names=_S, conf_stm_next_due_date=_D,
    conf_stm_last_made_up_date=_D, raw_data=_S,
)
OFFICER_DATA = _struct(
    company_number=_S, officer_name=_S, officer_role=_S, appointed_on=_D, resigned_on=_D, date_of_birth=_D,
    nationality=_S, nature_of_control=_S, address_line_1=_S, address_line_2=_S, locality=_S, postal_code=_S,
    country=_S, raw_data=_S,
)
FINANCIAL_DATA = _struct(
    company_number=_S, period_start=_D, period_end=_D,
    **{name: MONEY for name in MONEY_TAGS},
    **{name: _I for name in COUNT_TAGS},
    **{name: _S for name in TEXT_TAGS if name != "period_start"},
    cash_receipts_from_disposal_non_controlling_interests=_S, source=_S, raw_data=_S,
)

STAGING_COMPANIES = _struct(**{f.name: f.dataType for f in COMPANY_DATA}, **LINEAGE)
STAGING_OFFICERS = _struct(**{f.name: f.dataType for f in OFFICER_DATA}, **LINEAGE)
STAGING_FINANCIALS = _struct(**{f.name: f.dataType for f in FINANCIAL_DATA}, **LINEAGE)

PRODUCTION_LINEAGE = dict(first_seen=_TS, last_updated=_TS, raw_data=_S, source_batch_id=_S)

PRODUCTION_COMPANIES = _struct(
    **{f.name: f.dataType for f in COMPANY_DATA if f.name != "raw_data"},
    primary_sic_code=_S, industry_category=_S, dissolution_date=_D, data_quality_score=SCORE, **PRODUCTION_LINEAGE,
)
PRODUCTION_OFFICERS = _struct(
    **{f.name: f.dataType for f in OFFICER_DATA if f.name != "raw_data"}, is_active=_B, **PRODUCTION_LINEAGE
)
PRODUCTION_FINANCIALS = _struct(
    company_number=_S, period_start=_D, period_end=_D, turnover=MONEY, cost_of_sales=MONEY, gross_profit=MONEY,
    operating_profit=MONEY, profit_before_tax=MONEY, profit_after_tax=MONEY, total_assets=MONEY,
    current_assets=MONEY, fixed_assets=MONEY, total_liabilities=MONEY, current_liabilities=MONEY,
    long_term_liabilities=MONEY, net_worth=MONEY, debt_to_equity_ratio=RATIO, current_ratio=RATIO,
    profit_margin=RATIO, source=_S, data_quality_score=SCORE, filed_at=_TS, **PRODUCTION_LINEAGE,
)
CONTACTS = _struct(
    officer_id=_L, email=_S, email_verified=_B, phone=_S, phone_verified=_B, linkedin_url=_S, source=_S,
    confidence_score=SCORE, enriched_at=_TS, verified_at=_TS, last_attempted_contact=_TS, raw_data=_S,
    source_batch_id=_S,
)
INGESTION_LOG = _struct(
    batch_id=_S, search_name=_S, status=_S, started_at=_TS, completed_at=_TS, companies_count=_L, error_message=_S,
    metadata=_S, files_total=_L, files_completed=_L, current_file=_S, current_file_progress=_I, logged_at=_TS,
)
FILE_LOG = _struct(batch_id=_S, product=_S, file=_S, status=_S, rows=_L, rejects=_L, logged_at=_TS)
MERGE_LOG = _struct(
    batch_id=_S, merged_at=_TS, companies_merged=_L, officers_merged=_L, financials_merged=_L, contacts_merged=_L,
    merged_by=_S, notes=_S,
)

COMPANY_KEY = ["company_number"]
OFFICER_KEY = ["company_number", "officer_name", "appointed_on", "officer_role", "date_of_birth"]
FINANCIAL_KEY = ["company_number", "period_end"]

# Fields that decide whether a stored row has changed.
COMPANY_HASH = [
    "company_number", "company_name", "company_status", "company_type", "locality", "postal_code", "address_line_1",
    "address_line_2", "region", "country", "sic_codes", "incorporation_date", "accounts_next_due_date",
    "num_mort_charges", "previous_names",
]
OFFICER_HASH = [
    "company_number", "officer_name", "officer_role", "date_of_birth", "nationality", "nature_of_control",
    "resigned_on", "locality", "postal_code", "address_line_1", "address_line_2", "country",
]
FINANCIAL_HASH = [
    "company_number", "period_end", "turnover", "profit_loss", "total_assets", "total_liabilities",
    "net_assets_liabilities",
]

# Longest text each table column may hold.
TEXT_LIMITS = {
    "company_number": 8, "company_name": 500, "company_status": 50, "company_type": 100, "locality": 200,
    "postal_code": 20, "address_line_1": 500, "address_line_2": 500, "region": 100, "country": 100,
    "accounts_ref_date": 5, "account_category": 30, "primary_sic_code": 5, "industry_category": 200,
    "officer_name": 500, "officer_role": 200, "nationality": 100, "production_software_name": 255,
    "production_software_version": 100, "report_title": 255, "entity_current_legal_or_registered_name": 255,
    "name_entity_officer": 255, "entity_trading_status": 255, "source": 50,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, in its order and types: missing ones NULL, unknown ones dropped, bad values NULL."""

    have = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField) -> str:
        name, kind = f"`{field.name}`", field.dataType.simpleString()
        if field.name not in have:
            return f"CAST(NULL AS {kind}) AS {name}"
        if have[field.name] == field.dataType:
            return name
        if isinstance(have[field.name], T.StringType) and isinstance(field.dataType, T.IntegerType):
            return f"try_cast(try_cast({name} AS double) AS int) AS {name}"
        return f"try_cast({name} AS {kind}) AS {name}"

    return df.selectExpr(*[column(field) for field in schema])
