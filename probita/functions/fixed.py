"""Texts, codes and word stems that the results depend on, as the declarations and rules define them."""

#: Placeholder texts and their statuses.
PLACEHOLDERS = {
    "[Конфіденційна інформація]": "confidential",
    "[Не застосовується]": "not_applicable",
    "[Не відомо]": "unknown",
    "[Член сім'ї не надав інформацію]": "family_no_info",
}
#: Codes of extended statuses; 0 and others mean none.
EXTENDED = {1: "not_applicable", 2: "unknown", 3: "family_no_info"}
#: Statuses that hide a value.
HIDDEN = ("unknown", "family_no_info", "confidential", "redacted_other")
CONFIDENTIAL = ("confidential", "redacted_other")
#: Stems of currency names, in the order in which they are tried.
CURRENCY_STEMS = (("грн", "UAH"), ("гривня", "UAH"), ("гривні", "UAH"), ("долар", "USD"), ("євро", "EUR"))
#: Rates to hryvnia.
RATES = {"UAH": "1", "USD": "37", "EUR": "40", "GBP": "46", "PLN": "9", "CHF": "42", "CAD": "28", "CZK": "1.65", "JPY": "0.25"}
CASH_WORDS = ("готівкові", "готівка")
BANK_WORDS = ("банківських", "фінансових", "внески")
CASH_STEM = ("готів",)
HOME_STEMS = ("кварт", "буд", "жит")
LAND_STEM = ("зем",)
TRADE_STEMS = ("нежит", "офіс", "магаз", "комер")
CITY_STEMS = ("київ", "kyiv", "льв", "lviv", "одес", "odesa", "харк", "khark")
LUXURY_BRANDS = ("bmw", "mercedes", "range rover", "porsche", "lexus", "audi", "tesla")
MACHINE_STEMS = ("тракт", "комбай", "harvest")
AGRI_INCOME_STEMS = ("агро", "ферм", "сг", "оренд", "rent")
RENT_INCOME_STEMS = ("оренд", "rent", "бізнес", "business", "підприєм")
ONE_OFF_STEMS = ("спад", "inherit", "sale", "продаж", "gift", "дар")
TIMELINE_ONE_OFF_STEMS = ("спад", "успад", "inherit", "продаж", "sale", "дар", "дарув", "gift")
#: Three lists of relations that differ on purpose: for TQ5, for CR7 and for CR11 and CR12.
MINOR_STEMS_TQ5 = ("дит", "child", "син", "дон")
MINOR_STEMS_CR7 = ("дит", "child", "син", "донь")
KIN_STEMS = ("друж", "чолов", "дит", "child", "син", "дон")
HOME_COUNTRIES = ("1", "ua", "ukr", "ukraine", "україна")
OTHER_VEHICLE = "Інше"
SEVERITY = {"LOW": 0.5, "MEDIUM": 1.0, "HIGH": 1.5, "EXTREME": 2.0}
TYPE_LABELS = {1: "Annual", 2: "Initial", 3: "Cessation"}
BANDS = ((0.0, "None"), (20.0, "Low"), (40.0, "Moderate"), (70.0, "High"))
#: Titles of the rules.
RULE_TITLES = {
    "TQ1": "Ownership dates unreadable or after the declaration year", "TQ2": "References to persons who are not declared", "TQ3": "Shares of a property that do not add up",
    "TQ4": "Numbers that cannot be read or are out of range", "TQ5": "Real estate said not to apply against signs of residence", "cash_to_bank_ratio": "Cash far above bank deposits",
    "CR1": "Cash far above annual income", "CR2": "Foreign cash far above annual income", "CR3": "Acquisition far above annual income", "CR4": "Several purchases on a low income",
    "CR5": "Assets grow while income does not", "CR6": "Unusually large home or land area", "CR7": "Vehicles out of line with income or family", "CR8": "Farm land or machines without farm income",
    "CR9": "Rentable property without rent income", "CR10": "Major property of hidden value", "CR11": "Major property of relatives without income", "CR12": "Wealth concentrated on a relative",
    "CR13": "Relatives withhold information", "CR14": "Major assets appear or disappear", "CR15": "Real estate far above three years of income", "CR16": "Outlier among peers",
    "BR1": "Many declarations in a year", "BR2": "Growing share of hidden values", "BR3": "Many confidential fields among peers", "BR4": "Assets grow with a change of position",
    "unexplained_wealth": "Wealth that income does not explain", "unknown_value_frequency": "Values often hidden", "acquisition_income_mismatch": "Acquisition beyond income",
    "zero_income_with_assets": "Assets without any income", "family_asset_concentration": "Assets held by relatives", "income_outlier": "Income outlier among peers", "wealth_outlier": "Wealth outlier among peers",
    "yoy_income_change": "Sudden change of income", "yoy_asset_growth": "Monetary assets grow beyond income", "foreign_cash_jump": "Sudden growth of cash",
}
#: What each rule looks at.
RULE_LOGIC = {
    "TQ1": "Counts dates of ownership that cannot be read or lie after the year declared.", "TQ2": "Counts references to persons that are neither the declarant nor declared relatives.",
    "TQ3": "Adds up the shares of each property and expects about a whole.", "TQ4": "Counts numbers that are no numbers or lie beyond what is plausible.",
    "TQ5": "Compares a real estate section said not to apply with residence and income in the country.", "cash_to_bank_ratio": "Compares cash with deposits in banks.",
    "CR1": "Compares cash with an annual income.", "CR2": "Compares cash in foreign currencies with an annual income.", "CR3": "Compares the largest acquisition of the year with its income.",
    "CR4": "Counts larger purchases in a year of low income.", "CR5": "Compares the growth of assets with that of income from one declaration to the next.", "CR6": "Adds up areas of homes and of land.",
    "CR7": "Compares number and brands of vehicles with income and family.", "CR8": "Looks for income from farming where there is farm land or machinery.", "CR9": "Looks for income from rent where there is property to let.",
    "CR10": "Counts major property whose value is not given.", "CR11": "Looks for major property of close relatives with little income of their own.", "CR12": "Compares what a relative with little income holds with what the declarant holds.",
    "CR13": "Counts values that relatives did not give.", "CR14": "Looks for major property that appears or goes without income or sale to match.", "CR15": "Compares real estate with the mean income of three years.",
    "CR16": "Compares income, wealth and cash with those of peers of the same year.", "BR1": "Counts declarations of one year.", "BR2": "Compares the share of hidden values from one declaration to the next.",
    "BR3": "Compares the share of confidential fields with that of peers.", "BR4": "Compares the growth of assets around a change of position.",
    "unexplained_wealth": "Compares all assets with an annual income.", "unknown_value_frequency": "Measures the share of fields that are not known.", "acquisition_income_mismatch": "Compares the largest acquisition with the annual income.",
    "zero_income_with_assets": "Looks for assets where no income is declared.", "family_asset_concentration": "Measures the share of assets that relatives hold.",
    "income_outlier": "Ranks income among peers.", "wealth_outlier": "Ranks wealth among peers.",
    "yoy_income_change": "Compares income from one declaration to the next.", "yoy_asset_growth": "Compares the growth of money with income.", "foreign_cash_jump": "Measures the growth of cash from one declaration to the next.",
}
