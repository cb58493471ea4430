"""Declared schemas of the 22 tables (L1) and the data dictionary.

Each column carries its Spark type and, as field metadata, the declared
maximum text length, NOT NULL, default, allowed values (CHECK ... IN),
personal-data tag and whether it was fixed-width text (compared ignoring
trailing blanks).  Nothing is inferred: loads read with these schemas.

The column lists are the declared data model (generated once from
FIXTURES.md section 3, which transcribes the schema script).  Table
comments, row-count minimums and unique keys are fixed values that must
equal the model's, stated below in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

REF, DW = "ref", "dw"

# default markers (literal defaults are stored as their SQL text)
CURRENT_DATE, CURRENT_TIMESTAMP, UUID = "CURRENT_DATE", "CURRENT_TIMESTAMP", "UUID"


@dataclass(frozen=True)
class Col:
    name: str
    dtype: str
    max_len: int | None = None
    nullable: bool = True
    default: object = None
    domain: tuple | None = None
    key: bool = False
    pii: bool = False
    fixed: bool = False

    def field(self) -> T.StructField:
        meta = {k: v for k, v in (
            ("max_len", self.max_len), ("default", _meta_default(self.default)),
            ("domain", list(self.domain) if self.domain else None), ("key", self.key or None),
            ("pii", self.pii or None), ("fixed", self.fixed or None), ("not_null", (not self.nullable) or None),
        ) if v is not None}
        # Parquet tables accept NULL into NOT NULL columns, so the Spark field
        # stays nullable; NOT NULL is enforced by quality.not_null_check.
        return T.StructField(self.name, spark_type(self.dtype), True, meta)


_SIMPLE = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
           "smallint": T.ShortType(), "boolean": T.BooleanType(), "date": T.DateType(),
           "timestamp_ntz": T.TimestampNTZType()}


def spark_type(dtype: str) -> T.DataType:
    if dtype.startswith("decimal("):
        p, s = dtype[len("decimal("):-1].split(",")
        return T.DecimalType(int(p), int(s))
    return _SIMPLE[dtype]


def _meta_default(d):
    if d is None:
        return None
    return str(d).upper() if isinstance(d, bool) else str(d)


TABLES: dict[str, tuple[str, list[Col]]] = {
    'country': (REF, [
        Col('country_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('country_code_2', 'string', max_len=2, fixed=True),
        Col('country_name', 'string', max_len=100, nullable=False),
        Col('region', 'string', max_len=50),
        Col('sub_region', 'string', max_len=80),
        Col('aml_risk_rating', 'string', max_len=10, domain=('LOW', 'MEDIUM', 'HIGH', 'BLACKLIST')),
        Col('fatf_member', 'boolean', default=False),
        Col('fatf_grey_list', 'boolean', default=False),
        Col('fatf_black_list', 'boolean', default=False),
        Col('eu_member', 'boolean', default=False),
        Col('gdpr_adequate', 'boolean', default=False),
        Col('sanctions_risk_flag', 'boolean', default=False),
        Col('fatca_iga_type', 'string', max_len=10, domain=('MODEL_1', 'MODEL_2', 'NONE')),
        Col('calling_code', 'string', max_len=10),
        Col('is_active', 'boolean', default=True),
    ]),
    'currency': (REF, [
        Col('currency_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('currency_name', 'string', max_len=100, nullable=False),
        Col('currency_symbol', 'string', max_len=5),
        Col('minor_unit_decimals', 'smallint', default='2'),
        Col('is_active', 'boolean', default=True),
        Col('is_restricted', 'boolean', default=False),
        Col('is_reporting_currency', 'boolean', default=False),
        Col('country_code', 'string', max_len=3, fixed=True),
    ]),
    'exchange_rate': (REF, [
        Col('rate_id', 'string', max_len=36, nullable=False, default=UUID),
        Col('from_currency_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('to_currency_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('rate_type', 'string', max_len=20, nullable=False, domain=('SPOT', 'TT_BUY', 'TT_SELL', 'CARD_RATE', 'MID_RATE')),
        Col('rate_date', 'date', nullable=False),
        Col('rate_value', 'decimal(15,8)', nullable=False),
        Col('rate_source', 'string', max_len=50, default='INTERNAL'),
        Col('valid_from_datetime', 'timestamp_ntz', nullable=False),
        Col('valid_to_datetime', 'timestamp_ntz'),
    ]),
    'dim_date': (DW, [
        Col('date_sk', 'int', nullable=False),
        Col('full_date', 'date', nullable=False),
        Col('day_of_week_num', 'smallint'),
        Col('day_of_week_name', 'string', max_len=10),
        Col('day_of_month', 'smallint'),
        Col('week_of_year', 'smallint'),
        Col('month_num', 'smallint'),
        Col('month_name', 'string', max_len=10),
        Col('quarter_num', 'smallint'),
        Col('quarter_name', 'string', max_len=2, fixed=True),
        Col('calendar_year', 'smallint'),
        Col('fiscal_year', 'smallint'),
        Col('fiscal_quarter', 'smallint'),
        Col('fiscal_month', 'smallint'),
        Col('is_weekend', 'boolean', default=False),
        Col('is_public_holiday', 'boolean', default=False),
        Col('is_bank_working_day', 'boolean', default=True),
        Col('is_month_end', 'boolean', default=False),
        Col('is_quarter_end', 'boolean', default=False),
        Col('is_year_end', 'boolean', default=False),
        Col('is_fiscal_month_end', 'boolean', default=False),
        Col('days_in_month', 'smallint'),
        Col('days_remaining_month', 'smallint'),
        Col('prior_year_date_sk', 'int'),
    ]),
    'dim_geography': (DW, [
        Col('geography_sk', 'int', nullable=False, key=True),
        Col('country_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('country_code_2', 'string', max_len=2, fixed=True),
        Col('country_name', 'string', max_len=100, nullable=False),
        Col('region', 'string', max_len=50),
        Col('sub_region', 'string', max_len=80),
        Col('aml_risk_rating', 'string', max_len=10, domain=('LOW', 'MEDIUM', 'HIGH', 'BLACKLIST')),
        Col('fatf_member', 'boolean', default=False),
        Col('fatf_grey_list', 'boolean', default=False),
        Col('fatf_black_list', 'boolean', default=False),
        Col('eu_member', 'boolean', default=False),
        Col('gdpr_adequate', 'boolean', default=False),
        Col('sanctions_risk_flag', 'boolean', default=False),
        Col('fatca_iga_type', 'string', max_len=10),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'dim_currency': (DW, [
        Col('currency_sk', 'int', nullable=False, key=True),
        Col('currency_code', 'string', max_len=3, nullable=False, fixed=True),
        Col('currency_name', 'string', max_len=100, nullable=False),
        Col('currency_symbol', 'string', max_len=5),
        Col('minor_unit_decimals', 'smallint', default='2'),
        Col('country_sk', 'int'),
        Col('is_active', 'boolean', default=True),
        Col('is_restricted', 'boolean', default=False),
        Col('is_reporting_currency', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'dim_customer': (DW, [
        Col('customer_sk', 'bigint', nullable=False, key=True),
        Col('customer_nk', 'string', max_len=36, nullable=False),
        Col('customer_number', 'string', max_len=30),
        Col('full_name', 'string', max_len=255, pii=True),
        Col('first_name', 'string', max_len=100, pii=True),
        Col('last_name', 'string', max_len=100, pii=True),
        Col('date_of_birth', 'date', pii=True),
        Col('age_band', 'string', max_len=20),
        Col('gender', 'string', max_len=15),
        Col('nationality_country_sk', 'int'),
        Col('residency_country_sk', 'int'),
        Col('customer_type', 'string', max_len=20, domain=('INDIVIDUAL', 'ORGANIZATION', 'TRUST')),
        Col('customer_segment', 'string', max_len=30),
        Col('customer_sub_segment', 'string', max_len=50),
        Col('kyc_status', 'string', max_len=20, domain=('VERIFIED', 'PENDING', 'EXPIRED', 'REJECTED')),
        Col('kyc_expiry_date', 'date'),
        Col('risk_rating', 'string', max_len=10, domain=('LOW', 'MEDIUM', 'HIGH', 'VERY_HIGH')),
        Col('pep_flag', 'boolean', default=False),
        Col('sanctions_flag', 'boolean', default=False),
        Col('fatca_flag', 'boolean', default=False),
        Col('crs_flag', 'boolean', default=False),
        Col('acquisition_channel', 'string', max_len=30),
        Col('acquisition_date', 'date'),
        Col('relationship_tenure_yrs', 'decimal(5,1)'),
        Col('branch_sk', 'int'),
        Col('relationship_mgr_sk', 'int'),
        Col('annual_income_band', 'string', max_len=20),
        Col('employment_status', 'string', max_len=30),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
        Col('dw_source_system', 'string', max_len=50, default='CBS'),
    ]),
    'dim_product': (DW, [
        Col('product_sk', 'int', nullable=False, key=True),
        Col('product_nk', 'string', max_len=36, nullable=False),
        Col('product_code', 'string', max_len=20, nullable=False),
        Col('product_name', 'string', max_len=200, nullable=False),
        Col('product_category', 'string', max_len=50),
        Col('product_sub_category', 'string', max_len=50),
        Col('target_segment', 'string', max_len=30),
        Col('is_islamic', 'boolean', default=False),
        Col('islamic_contract_type', 'string', max_len=30),
        Col('product_status', 'string', max_len=20, domain=('ACTIVE', 'DISCONTINUED', 'SUSPENDED')),
        Col('launch_date', 'date'),
        Col('base_interest_rate', 'decimal(8,4)'),
        Col('min_loan_amount', 'decimal(20,2)'),
        Col('max_loan_amount', 'decimal(20,2)'),
        Col('requires_collateral', 'boolean', default=False),
        Col('gl_code_asset', 'string', max_len=20),
        Col('gl_code_liability', 'string', max_len=20),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'dim_branch': (DW, [
        Col('branch_sk', 'int', nullable=False, key=True),
        Col('branch_nk', 'string', max_len=36, nullable=False),
        Col('branch_code', 'string', max_len=10, nullable=False),
        Col('branch_name', 'string', max_len=200, nullable=False),
        Col('branch_type', 'string', max_len=30),
        Col('channel_category', 'string', max_len=20, domain=('PHYSICAL', 'DIGITAL', 'HYBRID')),
        Col('region_name', 'string', max_len=100),
        Col('city', 'string', max_len=100),
        Col('country_sk', 'int'),
        Col('swift_bic_code', 'string', max_len=20),
        Col('branch_status', 'string', max_len=20, domain=('OPEN', 'CLOSED', 'TEMPORARILY_CLOSED')),
        Col('manager_employee_sk', 'int'),
        Col('latitude', 'decimal(9,6)'),
        Col('longitude', 'decimal(9,6)'),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
    ]),
    'dim_employee': (DW, [
        Col('employee_sk', 'int', nullable=False, key=True),
        Col('employee_nk', 'string', max_len=36, nullable=False),
        Col('employee_number', 'string', max_len=20),
        Col('full_name', 'string', max_len=200, pii=True),
        Col('job_title', 'string', max_len=100),
        Col('job_function', 'string', max_len=50),
        Col('department_name', 'string', max_len=100),
        Col('branch_sk', 'int'),
        Col('manager_employee_sk', 'int'),
        Col('hire_date', 'date'),
        Col('employment_status', 'string', max_len=20, domain=('ACTIVE', 'ON_LEAVE', 'TERMINATED')),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
    ]),
    'dim_account': (DW, [
        Col('account_sk', 'bigint', nullable=False, key=True),
        Col('account_nk', 'string', max_len=36, nullable=False),
        Col('account_number', 'string', max_len=34, pii=True),
        Col('account_type', 'string', max_len=30),
        Col('account_status', 'string', max_len=20, domain=('ACTIVE', 'DORMANT', 'FROZEN', 'CLOSED', 'PENDING')),
        Col('product_sk', 'int'),
        Col('customer_sk', 'bigint'),
        Col('branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('open_date', 'date'),
        Col('close_date', 'date'),
        Col('interest_rate', 'decimal(8,4)'),
        Col('interest_rate_type', 'string', max_len=20),
        Col('overdraft_limit', 'decimal(20,2)', default='0'),
        Col('customer_segment', 'string', max_len=30),
        Col('is_salary_account', 'boolean', default=False),
        Col('is_dormant', 'boolean', default=False),
        Col('dormancy_date', 'date'),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'dim_gl_account': (DW, [
        Col('gl_account_sk', 'int', nullable=False, key=True),
        Col('gl_account_nk', 'string', max_len=36),
        Col('gl_account_code', 'string', max_len=20, nullable=False),
        Col('gl_account_name', 'string', max_len=200, nullable=False),
        Col('account_class', 'string', max_len=20, domain=('ASSET', 'LIABILITY', 'EQUITY', 'INCOME', 'EXPENSE')),
        Col('account_type', 'string', max_len=50),
        Col('normal_balance_side', 'string', max_len=6, domain=('DEBIT', 'CREDIT')),
        Col('level1_name', 'string', max_len=100),
        Col('level2_name', 'string', max_len=100),
        Col('level3_name', 'string', max_len=100),
        Col('level4_name', 'string', max_len=100),
        Col('level5_name', 'string', max_len=100),
        Col('is_posting_account', 'boolean', default=True),
        Col('ifrs_statement_line', 'string', max_len=100),
        Col('is_interest_income', 'boolean', default=False),
        Col('is_interest_expense', 'boolean', default=False),
        Col('is_provision', 'boolean', default=False),
        Col('is_fee_income', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'dim_collateral': (DW, [
        Col('collateral_sk', 'int', nullable=False, key=True),
        Col('collateral_nk', 'string', max_len=36, nullable=False),
        Col('collateral_type', 'string', max_len=50),
        Col('collateral_description', 'string', max_len=500),
        Col('owner_customer_sk', 'bigint'),
        Col('location_country_sk', 'int'),
        Col('nominal_value', 'decimal(20,2)'),
        Col('market_value', 'decimal(20,2)'),
        Col('eligible_value', 'decimal(20,2)'),
        Col('haircut_percentage', 'decimal(5,2)'),
        Col('legal_perfection_status', 'string', max_len=30),
        Col('valuation_date', 'date'),
        Col('status', 'string', max_len=20, domain=('ACTIVE', 'RELEASED', 'IMPAIRED', 'DISPOSED')),
        Col('effective_from_date', 'date', nullable=False, default=CURRENT_DATE),
        Col('effective_to_date', 'date'),
        Col('is_current_record', 'boolean', nullable=False, default=True),
    ]),
    'dim_aml_rule': (DW, [
        Col('aml_rule_sk', 'int', nullable=False, key=True),
        Col('rule_nk', 'string', max_len=36),
        Col('rule_name', 'string', max_len=200, nullable=False),
        Col('rule_type', 'string', max_len=30),
        Col('rule_category', 'string', max_len=50),
        Col('risk_typology', 'string', max_len=100),
        Col('alert_severity_default', 'string', max_len=10, domain=('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')),
        Col('threshold_description', 'string', max_len=500),
        Col('rule_version', 'string', max_len=20),
        Col('is_active', 'boolean', default=True),
        Col('ml_model_flag', 'boolean', default=False),
        Col('last_tuned_date', 'date'),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'bridge_account_customer': (DW, [
        Col('bridge_account_customer_sk', 'bigint', nullable=False, key=True),
        Col('account_sk', 'bigint', nullable=False),
        Col('customer_sk', 'bigint', nullable=False),
        Col('role_type', 'string', max_len=30, nullable=False),
        Col('ownership_weight', 'decimal(5,2)', default='100.00'),
        Col('effective_from_date', 'date'),
        Col('effective_to_date', 'date'),
        Col('is_current', 'boolean', default=True),
    ]),
    'bridge_loan_collateral': (DW, [
        Col('bridge_loan_collateral_sk', 'bigint', nullable=False, key=True),
        Col('account_sk', 'bigint', nullable=False),
        Col('collateral_sk', 'int', nullable=False),
        Col('allocation_percentage', 'decimal(5,2)', default='100.00'),
        Col('allocated_collateral_value', 'decimal(20,2)'),
        Col('effective_from_date', 'date'),
        Col('effective_to_date', 'date'),
    ]),
    'fact_transaction': (DW, [
        Col('transaction_sk', 'bigint', nullable=False, key=True),
        Col('transaction_nk', 'string', max_len=36, nullable=False),
        Col('transaction_reference', 'string', max_len=50),
        Col('booking_date_sk', 'int', nullable=False),
        Col('value_date_sk', 'int'),
        Col('transaction_datetime', 'timestamp_ntz', nullable=False),
        Col('account_sk', 'bigint'),
        Col('customer_sk', 'bigint'),
        Col('product_sk', 'int'),
        Col('branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('teller_employee_sk', 'int'),
        Col('counterparty_country_sk', 'int'),
        Col('transaction_type', 'string', max_len=30),
        Col('transaction_channel', 'string', max_len=30),
        Col('merchant_category_code', 'string', max_len=10),
        Col('amount_txn_ccy', 'decimal(20,2)', nullable=False),
        Col('amount_reporting_ccy', 'decimal(20,2)'),
        Col('fx_rate_applied', 'decimal(12,6)', default='1.000000'),
        Col('balance_after_txn', 'decimal(20,2)'),
        Col('is_credit', 'boolean', default=False),
        Col('is_debit', 'boolean', default=False),
        Col('is_reversal', 'boolean', default=False),
        Col('fraud_flag', 'boolean', default=False),
        Col('fraud_score', 'decimal(5,2)', default='0'),
        Col('aml_flag', 'boolean', default=False),
        Col('ctr_flag', 'boolean', default=False),
        Col('sar_linked_flag', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
        Col('dw_batch_id', 'string', max_len=50),
    ]),
    'fact_account_balance_daily': (DW, [
        Col('balance_snapshot_sk', 'bigint', nullable=False, key=True),
        Col('snapshot_date_sk', 'int', nullable=False),
        Col('account_sk', 'bigint', nullable=False),
        Col('customer_sk', 'bigint'),
        Col('product_sk', 'int'),
        Col('branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('current_balance', 'decimal(20,2)', nullable=False, default='0'),
        Col('available_balance', 'decimal(20,2)', default='0'),
        Col('hold_amount', 'decimal(20,2)', default='0'),
        Col('accrued_interest', 'decimal(20,2)', default='0'),
        Col('balance_reporting_ccy', 'decimal(20,2)'),
        Col('days_since_last_txn', 'int', default='0'),
        Col('transaction_count_day', 'int', default='0'),
        Col('credit_amount_day', 'decimal(20,2)', default='0'),
        Col('debit_amount_day', 'decimal(20,2)', default='0'),
        Col('is_dormant_flag', 'boolean', default=False),
        Col('is_overdrawn', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'fact_loan_daily_snapshot': (DW, [
        Col('loan_snapshot_sk', 'bigint', nullable=False, key=True),
        Col('snapshot_date_sk', 'int', nullable=False),
        Col('account_sk', 'bigint', nullable=False),
        Col('customer_sk', 'bigint'),
        Col('product_sk', 'int'),
        Col('branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('loan_type', 'string', max_len=30),
        Col('outstanding_principal', 'decimal(20,2)', default='0'),
        Col('outstanding_interest', 'decimal(20,2)', default='0'),
        Col('outstanding_fees', 'decimal(20,2)', default='0'),
        Col('total_outstanding', 'decimal(20,2)', default='0'),
        Col('total_outstanding_rcy', 'decimal(20,2)', default='0'),
        Col('days_past_due', 'int', default='0'),
        Col('past_due_amount', 'decimal(20,2)', default='0'),
        Col('dpd_bucket', 'string', max_len=10, domain=('0', '1-30', '31-60', '61-90', '91-180', '180+', 'NPL')),
        Col('ifrs9_stage', 'smallint', domain=('1', '2', '3')),
        Col('ecl_provision_amount', 'decimal(20,2)', default='0'),
        Col('ecl_pd', 'decimal(8,6)', default='0'),
        Col('ecl_lgd', 'decimal(8,6)', default='0'),
        Col('ecl_ead', 'decimal(20,2)', default='0'),
        Col('credit_grade', 'string', max_len=10),
        Col('is_npl_flag', 'boolean', default=False),
        Col('is_restructured', 'boolean', default=False),
        Col('is_written_off', 'boolean', default=False),
        Col('collateral_value', 'decimal(20,2)', default='0'),
        Col('loan_to_value_ratio', 'decimal(6,4)'),
        Col('interest_rate', 'decimal(8,4)'),
        Col('accrued_interest_rcy', 'decimal(20,2)', default='0'),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'fact_payment_order': (DW, [
        Col('payment_order_sk', 'bigint', nullable=False, key=True),
        Col('payment_nk', 'string', max_len=36, nullable=False),
        Col('instruction_date_sk', 'int', nullable=False),
        Col('settlement_date_sk', 'int'),
        Col('debtor_account_sk', 'bigint'),
        Col('debtor_customer_sk', 'bigint'),
        Col('debtor_branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('creditor_country_sk', 'int'),
        Col('payment_type', 'string', max_len=30),
        Col('payment_status', 'string', max_len=20),
        Col('rejection_reason_code', 'string', max_len=50),
        Col('sanctions_screening_status', 'string', max_len=20, default='CLEAR'),
        Col('aml_screening_status', 'string', max_len=20, default='CLEAR'),
        Col('payment_amount', 'decimal(20,2)', nullable=False),
        Col('payment_amount_rcy', 'decimal(20,2)'),
        Col('fx_rate_applied', 'decimal(12,6)', default='1.000000'),
        Col('charge_amount', 'decimal(12,2)', default='0'),
        Col('processing_time_seconds', 'int'),
        Col('is_cross_border', 'boolean', default=False),
        Col('is_stp', 'boolean', default=True),
        Col('is_rejected', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'fact_aml_alert': (DW, [
        Col('aml_alert_sk', 'bigint', nullable=False, key=True),
        Col('alert_nk', 'string', max_len=36, nullable=False),
        Col('generated_date_sk', 'int'),
        Col('assigned_date_sk', 'int'),
        Col('reviewed_date_sk', 'int'),
        Col('escalated_date_sk', 'int'),
        Col('closed_date_sk', 'int'),
        Col('sar_filed_date_sk', 'int'),
        Col('subject_customer_sk', 'bigint'),
        Col('subject_account_sk', 'bigint'),
        Col('triggering_transaction_sk', 'bigint'),
        Col('assigned_analyst_sk', 'int'),
        Col('branch_sk', 'int'),
        Col('aml_rule_sk', 'int'),
        Col('alert_type', 'string', max_len=50),
        Col('alert_severity', 'string', max_len=10, domain=('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')),
        Col('alert_status', 'string', max_len=30),
        Col('generated_by', 'string', max_len=30),
        Col('ml_risk_score', 'decimal(5,2)', default='0'),
        Col('alert_amount', 'decimal(20,2)'),
        Col('alert_amount_rcy', 'decimal(20,2)'),
        Col('days_to_assign', 'int'),
        Col('days_to_close', 'int'),
        Col('is_false_positive', 'boolean', default=False),
        Col('is_sar_filed', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
    'fact_gl_balance': (DW, [
        Col('gl_balance_sk', 'bigint', nullable=False, key=True),
        Col('period_end_date_sk', 'int', nullable=False),
        Col('gl_account_sk', 'int', nullable=False),
        Col('branch_sk', 'int'),
        Col('currency_sk', 'int'),
        Col('cost_center_code', 'string', max_len=20),
        Col('profit_center_code', 'string', max_len=20),
        Col('period_type', 'string', max_len=10, domain=('MONTHLY', 'QUARTERLY', 'ANNUAL')),
        Col('opening_balance', 'decimal(22,2)', default='0'),
        Col('total_debits', 'decimal(22,2)', default='0'),
        Col('total_credits', 'decimal(22,2)', default='0'),
        Col('closing_balance', 'decimal(22,2)', default='0'),
        Col('closing_balance_rcy', 'decimal(22,2)', default='0'),
        Col('ytd_balance', 'decimal(22,2)', default='0'),
        Col('budget_amount', 'decimal(22,2)'),
        Col('variance_vs_budget', 'decimal(22,2)'),
        Col('prior_year_balance', 'decimal(22,2)'),
        Col('yoy_variance', 'decimal(22,2)'),
        Col('is_audited', 'boolean', default=False),
        Col('dw_insert_datetime', 'timestamp_ntz', default=CURRENT_TIMESTAMP),
    ]),
}

# Table comments of the model, in declaration order.
TABLE_COMMENTS = {
    "dim_date": "Date dimension — SCD Type 0 (static). Grain: one row per calendar day.",
    "dim_geography": "Geography/Country dimension — SCD Type 2. Tracks FATF list changes.",
    "dim_currency": "Currency reference dimension — SCD Type 1.",
    "dim_customer": "Customer dimension — SCD Type 2. PII columns tagged: full_name, date_of_birth, first_name, last_name.",
    "dim_product": "Product catalog dimension — SCD Type 1.",
    "dim_branch": "Branch & channel dimension — SCD Type 2.",
    "dim_employee": "Employee dimension — SCD Type 2. PII: full_name.",
    "dim_account": "Account dimension — SCD Type 2. PII: account_number (IBAN).",
    "dim_gl_account": "GL Chart of Accounts dimension — SCD Type 1 with hierarchy roll-up levels.",
    "dim_collateral": "Collateral asset dimension — SCD Type 2 (market value changes trigger new version).",
    "dim_aml_rule": "AML rule/model dimension for AML Compliance mart.",
    "bridge_account_customer": "Bridge: M:N between accounts and customers (joint owners, guarantors).",
    "bridge_loan_collateral": "Bridge: M:N between loan accounts and collateral assets.",
    "fact_transaction": "Transactional fact. Grain: one row per posted financial transaction. Partitioned by booking_date_sk (YYYYMMDD).",
    "fact_account_balance_daily": "Periodic snapshot fact. Grain: one row per account per calendar day (EOD balance).",
    "fact_loan_daily_snapshot": "Periodic snapshot fact. Grain: one row per active loan per day. Contains IFRS 9 ECL fields, DPD buckets, and NPL flags.",
    "fact_payment_order": "Transactional fact. Grain: one row per payment order/instruction.",
    "fact_aml_alert": "Accumulating snapshot fact. Grain: one row per AML alert (updated as milestones occur).",
    "fact_gl_balance": "Periodic snapshot fact. Grain: one row per GL account per period per branch. Powers Financial Performance mart.",
}

# Minimum row counts checked after a load, in the load's order.
ROW_MINIMUMS = {
    "dim_date": 1000,
    "dim_geography": 25,
    "dim_currency": 10,
    "dim_branch": 15,
    "dim_employee": 50,
    "dim_product": 15,
    "dim_customer": 400,
    "dim_account": 800,
    "dim_collateral": 100,
    "dim_gl_account": 25,
    "dim_aml_rule": 10,
    "bridge_account_customer": 800,
    "bridge_loan_collateral": 100,
    "fact_transaction": 10000,
    "fact_account_balance_daily": 10000,
    "fact_loan_daily_snapshot": 2000,
    "fact_payment_order": 1500,
    "fact_aml_alert": 200,
    "fact_gl_balance": 2000,
}

# Unique codes (several NULLs allowed).
UNIQUE_KEYS = {
    "dim_currency": "currency_code",
    "dim_product": "product_code",
    "dim_gl_account": "gl_account_code",
}

# The comments of the mart views.
VIEW_COMMENTS = {
    "vw_customer_360": "Customer 360 mart view — aggregates account count, balance, product mix per customer.",
    "vw_credit_risk_portfolio": "Credit Risk mart view — IFRS 9 staging, NPL ratio, ECL by portfolio segment.",
    "vw_financial_performance": "Financial Performance mart view — P&L by period, branch, GL category with YoY and budget variance.",
    "vw_aml_compliance_dashboard": "AML Compliance mart view — alert volumes, false positive rates, SAR filing rates by rule, severity, "
                                   "and customer segment.",
    "vw_payments_analytics": "Payments & Liquidity mart view — STP rates, rejection rates, cross-border corridors, sanctions hits.",
}

# History kind per table (SCD type, or the fact's snapshot kind).
HISTORY = {
    "dim_date": "type0", "dim_geography": "type2", "dim_currency": "type1", "dim_customer": "type2",
    "dim_product": "type1", "dim_branch": "type2", "dim_employee": "type2", "dim_account": "type2",
    "dim_gl_account": "type1", "dim_collateral": "type2", "dim_aml_rule": "type1",
}

# Load order: reference tables, dimensions, bridges, facts.
LOAD_ORDER = list(TABLES)

# Array column that carries ``type:column`` tags from the raw values to the
# split into good and rejected rows.
MISFITS = "__misfits"


def columns(name: str) -> list[Col]:
    return TABLES[name][1]


def table_schema(name: str) -> T.StructType:
    """L1: the declared ``StructType`` of ``name`` with column metadata."""
    return T.StructType([c.field() for c in columns(name)])


def namespace(name: str) -> str:
    return TABLES[name][0]


def key_column(name: str) -> str | None:
    """The generated surrogate key of ``name``, if it has one."""
    keys = [c.name for c in columns(name) if c.key]
    return keys[0] if keys else None


def _reference_target(col: str) -> tuple[str, str] | None:
    """Rule for soft foreign keys: which dimension a ``*_sk`` column points to."""
    if not col.endswith("_sk"):
        return None
    if col.endswith("date_sk"):
        return "dim_date", "date_sk"
    if col.endswith("country_sk"):
        return "dim_geography", "geography_sk"
    if col.endswith("customer_sk"):
        return "dim_customer", "customer_sk"
    if col.endswith("transaction_sk"):
        return "fact_transaction", "transaction_sk"     # a fact that points at a fact
    if col in ("assigned_analyst_sk", "relationship_mgr_sk") or col.endswith("employee_sk"):
        return "dim_employee", "employee_sk"
    keys = {key_column(d): d for d in TABLES if d.startswith("dim_") and key_column(d)}
    if col in keys:
        return keys[col], col
    # longest dimension key that ends the column name (gl_account_sk before account_sk)
    for k in sorted(keys, key=len, reverse=True):
        if col.endswith("_" + k):
            return keys[k], k
    return None


def soft_foreign_keys() -> list[tuple[str, str, str, str]]:
    """(table, fk, referenced table, pk) for every reference the model declares
    by name, those into the table itself included."""
    out = []
    for t in TABLES:
        own = key_column(t)
        for c in columns(t):
            if c.name == own:
                continue
            target = _reference_target(c.name)
            if target and target[0] in TABLES and any(
                    x.name == target[1] for x in columns(target[0])):
                out.append((t, c.name, *target))
    return out
