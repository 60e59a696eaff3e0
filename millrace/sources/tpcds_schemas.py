"""Column schemas of the TPC-DS base tables that the queries read, as Spark DDL."""

# Names, order and types of the public TPC-DS schema.

WEB_SALES = """
ws_sold_date_sk bigint, ws_sold_time_sk bigint, ws_ship_date_sk bigint, ws_item_sk bigint not null, ws_bill_customer_sk bigint,
ws_bill_cdemo_sk bigint, ws_bill_hdemo_sk bigint, ws_bill_addr_sk bigint, ws_ship_customer_sk bigint, ws_ship_cdemo_sk bigint,
ws_ship_hdemo_sk bigint, ws_ship_addr_sk bigint, ws_web_page_sk bigint, ws_web_site_sk bigint, ws_ship_mode_sk bigint,
ws_warehouse_sk bigint, ws_promo_sk bigint, ws_order_number bigint not null, ws_quantity bigint, ws_wholesale_cost decimal(7,2),
ws_list_price decimal(7,2), ws_sales_price decimal(7,2), ws_ext_discount_amt decimal(7,2), ws_ext_sales_price decimal(7,2),
ws_ext_wholesale_cost decimal(7,2), ws_ext_list_price decimal(7,2), ws_ext_tax decimal(7,2), ws_coupon_amt decimal(7,2),
ws_ext_ship_cost decimal(7,2), ws_net_paid decimal(7,2), ws_net_paid_inc_tax decimal(7,2), ws_net_paid_inc_ship decimal(7,2),
ws_net_paid_inc_ship_tax decimal(7,2), ws_net_profit decimal(7,2)
"""

CATALOG_SALES = """
cs_sold_date_sk bigint, cs_sold_time_sk bigint, cs_ship_date_sk bigint, cs_bill_customer_sk bigint, cs_bill_cdemo_sk bigint,
cs_bill_hdemo_sk bigint, cs_bill_addr_sk bigint, cs_ship_customer_sk bigint, cs_ship_cdemo_sk bigint, cs_ship_hdemo_sk bigint,
cs_ship_addr_sk bigint, cs_call_center_sk bigint, cs_catalog_page_sk bigint, cs_ship_mode_sk bigint, cs_warehouse_sk bigint,
cs_item_sk bigint not null, cs_promo_sk bigint, cs_order_number bigint not null, cs_quantity bigint,
cs_wholesale_cost decimal(7,2), cs_list_price decimal(7,2), cs_sales_price decimal(7,2), cs_ext_discount_amt decimal(7,2),
cs_ext_sales_price decimal(7,2), cs_ext_wholesale_cost decimal(7,2), cs_ext_list_price decimal(7,2), cs_ext_tax decimal(7,2),
cs_coupon_amt decimal(7,2), cs_ext_ship_cost decimal(7,2), cs_net_paid decimal(7,2), cs_net_paid_inc_tax decimal(7,2),
cs_net_paid_inc_ship decimal(7,2), cs_net_paid_inc_ship_tax decimal(7,2), cs_net_profit decimal(7,2)
"""

WEB_RETURNS = """
wr_returned_date_sk bigint, wr_returned_time_sk bigint, wr_item_sk bigint not null, wr_refunded_customer_sk bigint,
wr_refunded_cdemo_sk bigint, wr_refunded_hdemo_sk bigint, wr_refunded_addr_sk bigint, wr_returning_customer_sk bigint,
wr_returning_cdemo_sk bigint, wr_returning_hdemo_sk bigint, wr_returning_addr_sk bigint, wr_web_page_sk bigint,
wr_reason_sk bigint, wr_order_number bigint not null, wr_return_quantity bigint, wr_return_amt decimal(7,2),
wr_return_tax decimal(7,2), wr_return_amt_inc_tax decimal(7,2), wr_fee decimal(7,2), wr_return_ship_cost decimal(7,2),
wr_refunded_cash decimal(7,2), wr_reversed_charge decimal(7,2), wr_account_credit decimal(7,2), wr_net_loss decimal(7,2)
"""

CATALOG_RETURNS = """
cr_returned_date_sk bigint, cr_returned_time_sk bigint, cr_item_sk bigint not null, cr_refunded_customer_sk bigint,
cr_refunded_cdemo_sk bigint, cr_refunded_hdemo_sk bigint, cr_refunded_addr_sk bigint, cr_returning_customer_sk bigint,
cr_returning_cdemo_sk bigint, cr_returning_hdemo_sk bigint, cr_returning_addr_sk bigint, cr_call_center_sk bigint,
cr_catalog_page_sk bigint, cr_ship_mode_sk bigint, cr_warehouse_sk bigint, cr_reason_sk bigint, cr_order_number bigint not null,
cr_return_quantity bigint, cr_return_amount decimal(7,2), cr_return_tax decimal(7,2), cr_return_amt_inc_tax decimal(7,2),
cr_fee decimal(7,2), cr_return_ship_cost decimal(7,2), cr_refunded_cash decimal(7,2), cr_reversed_charge decimal(7,2),
cr_store_credit decimal(7,2), cr_net_loss decimal(7,2)
"""

STORE_RETURNS = """
sr_returned_date_sk bigint, sr_return_time_sk bigint, sr_item_sk bigint not null, sr_customer_sk bigint, sr_cdemo_sk bigint,
sr_hdemo_sk bigint, sr_addr_sk bigint, sr_store_sk bigint, sr_reason_sk bigint, sr_ticket_number bigint not null,
sr_return_quantity bigint, sr_return_amt decimal(7,2), sr_return_tax decimal(7,2), sr_return_amt_inc_tax decimal(7,2),
sr_fee decimal(7,2), sr_return_ship_cost decimal(7,2), sr_refunded_cash decimal(7,2), sr_reversed_charge decimal(7,2),
sr_store_credit decimal(7,2), sr_net_loss decimal(7,2)
"""

DATE_DIM = """
d_date_sk bigint not null, d_date_id string not null, d_date date, d_month_seq bigint, d_week_seq bigint, d_quarter_seq bigint,
d_year bigint, d_dow bigint, d_moy bigint, d_dom bigint, d_qoy bigint, d_fy_year bigint, d_fy_quarter_seq bigint,
d_fy_week_seq bigint, d_day_name string, d_quarter_name string, d_holiday string, d_weekend string, d_following_holiday string,
d_first_dom bigint, d_last_dom bigint, d_same_day_ly bigint, d_same_day_lq bigint, d_current_day string, d_current_week string,
d_current_month string, d_current_quarter string, d_current_year string
"""

CUSTOMER_ADDRESS = """
ca_address_sk bigint not null, ca_address_id string not null, ca_street_number string, ca_street_name string,
ca_street_type string, ca_suite_number string, ca_city string, ca_county string, ca_state string, ca_zip string, ca_country string,
ca_gmt_offset decimal(7,2), ca_location_type string
"""

WEB_SITE = """
web_site_sk bigint not null, web_site_id string not null, web_rec_start_date date, web_rec_end_date date, web_name string,
web_open_date_sk bigint, web_close_date_sk bigint, web_class string, web_manager string, web_mkt_id bigint, web_mkt_class string,
web_mkt_desc string, web_market_manager string, web_company_id bigint, web_company_name string, web_street_number string,
web_street_name string, web_street_type string, web_suite_number string, web_city string, web_county string, web_state string,
web_zip string, web_country string, web_gmt_offset decimal(7,2), web_tax_percentage decimal(7,2)
"""

CALL_CENTER = """
cc_call_center_sk bigint not null, cc_call_center_id string not null, cc_rec_start_date date, cc_rec_end_date date,
cc_closed_date_sk bigint, cc_open_date_sk bigint, cc_name string, cc_class string, cc_employees bigint, cc_sq_ft bigint,
cc_hours string, cc_manager string, cc_mkt_id bigint, cc_mkt_class string, cc_mkt_desc string, cc_market_manager string,
cc_division bigint, cc_division_name string, cc_company bigint, cc_company_name string, cc_street_number string,
cc_street_name string, cc_street_type string, cc_suite_number string, cc_city string, cc_county string, cc_state string,
cc_zip string, cc_country string, cc_gmt_offset decimal(7,2), cc_tax_percentage decimal(7,2)
"""

STORE = """
s_store_sk bigint not null, s_store_id string not null, s_rec_start_date date, s_rec_end_date date, s_closed_date_sk bigint,
s_store_name string, s_number_employees bigint, s_floor_space bigint, s_hours string, s_manager string, s_market_id bigint,
s_geography_class string, s_market_desc string, s_market_manager string, s_division_id bigint, s_division_name string,
s_company_id bigint, s_company_name string, s_street_number string, s_street_name string, s_street_type string,
s_suite_number string, s_city string, s_county string, s_state string, s_zip string, s_country string, s_gmt_offset decimal(7,2),
s_tax_precentage decimal(7,2)
"""

CUSTOMER = """
c_customer_sk bigint not null, c_customer_id string not null, c_current_cdemo_sk bigint, c_current_hdemo_sk bigint,
c_current_addr_sk bigint, c_first_shipto_date_sk bigint, c_first_sales_date_sk bigint, c_salutation string, c_first_name string,
c_last_name string, c_preferred_cust_flag string, c_birth_day bigint, c_birth_month bigint, c_birth_year bigint,
c_birth_country string, c_login string, c_email_address string, c_last_review_date bigint
"""

TABLES = {"web_sales": WEB_SALES, "catalog_sales": CATALOG_SALES, "web_returns": WEB_RETURNS, "catalog_returns": CATALOG_RETURNS, "store_returns": STORE_RETURNS, "date_dim": DATE_DIM, "customer_address": CUSTOMER_ADDRESS, "web_site": WEB_SITE, "call_center": CALL_CENTER, "store": STORE, "customer": CUSTOMER}
