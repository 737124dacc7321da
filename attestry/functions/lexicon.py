"""Rule tables as data, in the order in which they are tried. Results depend on each entry and its place."""

from __future__ import annotations

CURRENCIES = [
    ("$", "USD"), ("usd", "USD"), ("dollar", "USD"), ("dollars", "USD"),
    ("€", "EUR"), ("eur", "EUR"), ("euro", "EUR"), ("euros", "EUR"),
    ("£", "GBP"), ("gbp", "GBP"), ("pound", "GBP"), ("pounds", "GBP"),
    ("¥", "JPY"), ("jpy", "JPY"), ("yen", "JPY"),
    ("₹", "INR"), ("inr", "INR"), ("rupee", "INR"), ("rupees", "INR"), ("rs", "INR"), ("rs.", "INR"),
    ("a$", "AUD"), ("aud", "AUD"), ("c$", "CAD"), ("cad", "CAD"), ("chf", "CHF"), ("sgd", "SGD"), ("s$", "SGD"),
    ("cny", "CNY"), ("rmb", "CNY"),
]
SCALES = [
    ("trillion", 1e12), ("trillions", 1e12), ("tn", 1e12),
    ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("b", 1e9),
    ("crore", 1e7), ("crores", 1e7), ("cr", 1e7), ("cr.", 1e7),
    ("million", 1e6), ("millions", 1e6), ("mn", 1e6), ("m", 1e6),
    ("lakh", 1e5), ("lakhs", 1e5), ("lac", 1e5), ("lacs", 1e5),
    ("thousand", 1e3), ("thousands", 1e3), ("k", 1e3),
]
COUNT_NOUNS = "employees|headcount|staff|workers|people|users|subscribers|customers|shares|units|vehicles|devices|shipments|parcels|packages|patients|beds|flights|passengers"
MASS_UNITS = "tons|tonnes|metric tons|mt|co2e|kg|lbs|pounds"
ENERGY_UNITS = "mwh|gwh|kwh|megawatt|gigawatt|watt|btu|joules"
STOPWORDS = ["the", "of", "and", "in", "for", "from", "at", "by", "on", "with", "to", "a", "an", "as", "our", "their", "its", "is", "was", "were", "has", "have"]
CORPORATE = "inc|corp|corporation|co|ltd|limited|llc|plc|group|holdings|technologies|company"
WILDCARD_ENTITY = "primary_entity"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
QUARTER_ENDS = ["march 31", "june 30", "september 30", "december 31"]
ORDINALS = ["first", "second", "third", "fourth"]

#: Concepts tried in order: id, family, words. Margins, ratios, growth, per-share and generic metrics are handled beside this table.
CONCEPTS = [
    ("total_income", "income_total", "total income"),
    ("other_income", "income_other", "other income|non-operating income|finance income|investment income"),
    ("revenue", "revenue", "revenue|revenues|turnover|sales|topline|top-line|billings|gross merchandise value|gmv"),
    ("net_profit", "profit_net", "profit after tax|pat|net profit|net income|net earnings|bottomline|bottom line"),
    ("profit_before_tax", "profit_pbt", "profit before tax|pbt|earnings before tax|ebt"),
    ("ebitda", "profit_ebitda", "ebitda"),
    ("operating_profit", "profit_operating", "operating income|operating profit|operating earnings|ebit"),
    ("gross_profit", "profit_gross", "gross profit"),
    ("expense_rd", "expense_rd", "research and development|r&d|research & development"),
    ("expense_sga", "expense_sga", "selling, general|sg&a|general and administrative|administrative expense"),
    ("expense_personnel", "expense_personnel", "employee benefit|staff cost|personnel cost|payroll"),
    ("expense_da", "expense_da", "depreciation and amortization|depreciation|amortization|d&a"),
    ("expense_finance", "expense_finance", "finance cost|interest expense|borrowing cost"),
    ("expense_tax", "expense_tax", "tax expense|income tax expense|current tax|tax provision"),
    ("expense_total", "expense_total", "cost of goods sold|cost of sales|cogs|operating expenses|total expenses|total expenditure"),
    ("free_cash_flow", "cash_flow_fcf", "free cash flow|fcf"),
    ("operating_cash_flow", "cash_flow_operating", "operating cash flow|cash from operations|cash flow from operating"),
    ("investing_cash_flow", "cash_flow_investing", "investing cash flow|cash used in investing"),
    ("financing_cash_flow", "cash_flow_financing", "financing cash flow|cash used in financing"),
    ("capex", "capex", "capital expenditure|capital expenditures|capex"),
    ("cash_equivalents", "cash_balance", "cash and cash equivalents|cash balance|bank balance|cash reserves"),
    ("total_assets", "assets_total", "total assets"),
    ("current_assets", "assets_current", "current assets"),
    ("fixed_assets", "assets_fixed", "non-current assets|fixed assets|property, plant and equipment|pp&e"),
    ("total_liabilities", "liabilities_total", "total liabilities"),
    ("current_liabilities", "liabilities_current", "current liabilities"),
    ("net_debt", "debt_net", "net debt"),
    ("total_debt", "debt", "total debt|borrowings|long-term debt|short-term debt"),
    ("total_equity", "equity", "total equity|shareholders equity|net worth|book value"),
    ("workforce_headcount", "workforce", "headcount|employee|employees|staff|workforce|full-time equivalent|fte"),
    ("customers_count", "customers", "customer count|customers|subscribers|active users|active clients|clients count"),
    ("volume_activity", "volume_activity", "shipments|parcels|packages|orders delivered|orders handled|units sold|freight volume|tonnage"),
    ("infrastructure", "infrastructure", "pincodes|facilities|warehouses|fulfillment centers|hubs|service centers|network reach|sq ft|square feet|fleet size"),
    ("contractual_backlog", "backlog", "backlog|remaining performance obligations|rpo|order book"),
    ("emissions_scope_1", "esg_emissions", "scope 1"),
    ("emissions_scope_2", "esg_emissions", "scope 2"),
    ("emissions_scope_3", "esg_emissions", "scope 3"),
    ("renewable_energy", "esg_energy", "renewable energy|clean energy"),
]
#: Names of concepts. Fixed values.
CONCEPT_LABELS = {
    "contingent_liability": "Contingent Liabilities",
    "margin_gross": "Gross Margin (%)", "margin_ebitda": "EBITDA Margin (%)", "margin_operating": "Operating Margin (%)", "margin_net": "Net Profit Margin (%)",
    "eps_diluted": "Diluted EPS", "eps_basic": "Basic EPS", "total_income": "Total Income", "other_income": "Other / Non-Operating Income",
    "revenue_total": "Total Revenue", "revenue_segment": "Segment Revenue",
    "net_profit": "Net Profit / PAT", "net_profit_adjusted": "Net Profit / PAT", "profit_before_tax": "Profit Before Tax (PBT)",
    "ebitda": "EBITDA", "ebitda_adjusted": "Adjusted EBITDA", "operating_profit": "Operating Profit / EBIT", "operating_profit_adjusted": "Adjusted Operating Profit", "gross_profit": "Gross Profit",
    "expense_rd": "R&D Expense", "expense_sga": "SG&A Expense", "expense_personnel": "Employee Benefit Expense", "expense_da": "Depreciation & Amortization",
    "expense_finance": "Finance Costs / Interest", "expense_tax": "Income Tax Expense", "expense_total": "Total / Operating Expenses",
    "free_cash_flow": "Free Cash Flow", "operating_cash_flow": "Operating Cash Flow", "investing_cash_flow": "Investing Cash Flow", "financing_cash_flow": "Financing Cash Flow",
    "capex": "Capital Expenditure (Capex)", "cash_equivalents": "Cash & Cash Equivalents",
    "total_assets": "Total Assets", "current_assets": "Current Assets", "fixed_assets": "Fixed / Non-Current Assets",
    "total_liabilities": "Total Liabilities", "current_liabilities": "Current Liabilities", "net_debt": "Net Debt", "total_debt": "Total Debt / Borrowings", "total_equity": "Total Equity / Net Worth",
    "workforce_headcount": "Workforce / Headcount", "customers_count": "Customers / Users", "volume_activity": "Physical Volume / Units", "infrastructure": "Network / Infrastructure", "contractual_backlog": "Contractual Backlog",
    "emissions_scope_1": "Scope 1 GHG Emissions", "emissions_scope_2": "Scope 2 GHG Emissions", "emissions_scope_3": "Scope 3 GHG Emissions", "renewable_energy": "Renewable Energy",
}
CONTINGENT = "contingent|contingency|pending litigation|disputed matter|bank guarantee"
RATIO = "margin|ratio|percentage|pct|yield|rate"
GROWTH = "growth|growth rate|yoy|cagr|increase of|decrease of"
PER_SHARE = "eps|earnings per share|per share|dps|dividend per share"
ADJUSTED = r"adjusted|adj\.?|non-gaap|non gaap|core|underlying"
SEGMENT = "segment|division|unit|express parcel|part truckload|supply chain"
MARGINS = [("margin_gross", "gross margin"), ("margin_ebitda", "ebitda margin"), ("margin_operating", "operating margin|ebit margin"), ("margin_net", "net margin|profit margin|pat margin")]

#: Keywords of categories, tried in order, anywhere in the metric's name.
CATEGORIES = [
    ("workforce", "employee|headcount|staff|workforce|attrition|turnover|diversity|payroll"),
    ("environmental", "emission|carbon|scope [1-3]|ghg|renewable|energy|waste|water|esg|climate"),
    ("operational", "user|subscriber|customer|volume|units|devices|deliveries|backlog|capacity|patent|shipments"),
    ("general", "lawsuit|compliance|regulatory|audit|fine|legal"),
]
BASES = [
    ("Non-GAAP", "non-gaap|non gaap|adjusted|adj|core|underlying"),
    ("Ind AS", "ind as|ind-as"),
    ("IFRS", "ifrs"),
    ("GAAP", "gaap|as reported|reported|statutory"),
    ("Constant Currency", "constant currency|fx-neutral|currency neutral"),
    ("Pro Forma", "pro forma|pro-forma"),
]
SCOPES = [
    ("Consolidated", "consolidated|group|enterprise-wide|company-wide"),
    ("Standalone", "standalone|parent|solo|unconsolidated"),
    ("Segment", "segment|division|business unit|subsidiary"),
]
GEOGRAPHIES = [
    ("North America", "north america|united states|us|usa|canada"),
    ("EMEA / Europe", "europe|emea|united kingdom|uk|germany|france"),
    ("APAC", "asia-pacific|asia pacific|apac|china|india|japan"),
    ("Latin America", "latin america|latam|brazil|mexico"),
    ("International", "international|overseas"),
    ("Domestic", "domestic"),
    ("Global", "global|worldwide"),
]
ESTIMATES = "guidance|target|forecast|projected|outlook|budget|plan|estimate"
NEGATIVE = "terminated|canceled|declined|failed|rejected|delayed|suspended|decreased"
POSITIVE = "completed|approved|surpassed|finalized|increased|achieved|expanded"
#: Variance (in percent, two decimals) up to which values corroborate, and token similarity that generic metrics need.
TOLERANCE, TOKEN_SIMILARITY = 1.0, 0.75

#: Metrics that lines of text are searched for, tried in order: display name, phrases (any white space or none between their words). Fixed values.
METRICS = [
    ("Total Revenue", "revenue from operations|total consolidated revenue|total revenue|net revenue|revenues|turnover|sales"),
    ("Cloud Platform Revenue", "cloud platform revenue|cloud segment revenue|cloud revenue"),
    ("Subscription Revenue", "subscription revenue|subscription and support revenue"),
    ("Services Revenue", "services revenue|service revenue"),
    ("Product Revenue", "products revenue|product revenue|hardware revenue"),
    ("Commercial Revenue", "commercial revenue|commercial segment revenue"),
    ("Retail Revenue", "retail revenue|retail segment revenue"),
    ("Enterprise Software Revenue", "enterprise software revenue|enterprise software division revenue"),
    ("Gross Profit", "gross profit"),
    ("Gross Margin", "gross margin"),
    ("Non-GAAP Operating Income", "non-gaap operating income|adjusted operating income"),
    ("Operating Income", "operating income|operating profit|ebit"),
    ("Operating Margin", "operating margin"),
    ("Adjusted EBITDA", "adjusted ebitda|service ebitda|operating ebitda"),
    ("EBITDA", "ebitda"),
    ("Net Income", "net income|net profit|profit after tax|pat"),
    ("Profit Before Tax", "profit before tax|pbt"),
    ("Diluted EPS", "diluted earnings per share|diluted eps"),
    ("Basic EPS", "basic earnings per share|basic eps"),
    ("Operating Cash Flow", "operating cash flow|cash provided by operating activities|cash from operating activities"),
    ("Free Cash Flow", "free cash flow|fcf"),
    ("Capital Expenditures", "capital expenditure|capital expenditures|capex"),
    ("Research and Development Expense", "research and development|r&d"),
    ("Cash and Cash Equivalents", "cash and cash equivalents|cash reserves"),
    ("Total Debt", "total debt|borrowings"),
    ("Total Assets", "total assets"),
    ("Headcount", "headcount|full-time employees|total employees|workforce"),
    ("Contractual Backlog", "backlog|remaining performance obligations|rpo"),
    ("Scope 1 GHG Emissions", "scope 1"),
    ("Scope 2 GHG Emissions", "scope 2"),
    ("Scope 3 GHG Emissions", "scope 3"),
]
#: What amounts in a line begin and end with, and what is counted; where several fit, the first counts. Fixed values.
AMOUNT_SYMBOLS = "$€£¥₹"
AMOUNT_CODES = "USD|EUR|GBP|INR|CAD|AUD"
AMOUNT_SCALES = ["trillion", "billion", "million", "thousand", "crores", "crore", "cr.", "cr", "lakhs", "lakh", "lacs", "lac", "b", "m", "k"]
PER_SHARE_ENDINGS = ["per share", "/share"]
COUNTED = ["full-time equivalent employees", "employees", "headcount", "workers", "staff", "metric tons", "tons", "tonnes", "subscribers", "users", "active users", "units", "shares", "customers", "packages", "shipments"]
#: What separates a row's label from its amount, and the marks that a label may hold. Fixed values.
LABEL_SEPARATORS, LABEL_MARKS = ":\t.-", "&()/-"
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Words at the end of a company's name, verbs that follow one, and words of file names that aren't part of one. Fixed values.
LEGAL_ENDINGS = "Inc|Corp|Corporation|LLC|Ltd|Limited|Group|Holdings|Technologies|Company|PLC|NV|SE|SA"
REPORTING_VERBS = "Reports|Announces|Releases|Files|Provides"
REPORT_WORDS = "annual|report|quarterly|release|earnings|form|10k|10q|press|investor|deck|presentation|slides|overview|summary|q1|q2|q3|q4"
UNKNOWN_ENTITY, UNKNOWN_PERIOD = "Reporting Entity", "Unspecified Period"
#: Words before "segment" or "division" that name none.
NO_SEGMENT = ["each", "every", "operating", "reportable", "the", "our", "this"]
#: Qualifiers of a figure: how they are named, and the words that tell them.
QUALIFIERS = [("Net of tax", "net of tax"), ("Constant FX", "constant currency|constant fx"), ("Annualized", "annualized"), ("Pro forma", "pro forma"), ("Diluted", "diluted"), ("Basic", "basic")]
#: What makes a page worth a model's time, and how many pages and characters it is given.
DATA_WORDS = r"[$€£¥₹%]|revenue|income|profit|ebitda|margin|debt|assets|capex|growth|cr|crore|lakh|sales|earnings|cash|headcount|\d{2,}"
MODEL_PAGES, MODEL_CHARS = 15, 2500
FACT_CATEGORIES = ["financial", "operational", "workforce", "environmental", "strategic", "general"]
