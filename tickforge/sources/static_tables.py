"""Fixed dimension tables: instruments, demand sources, regions and market events."""

from __future__ import annotations

# Instruments (symbol, name, contract multiplier).
INSTRUMENTS = [
    ("GC=F", "COMEX Gold Futures", 100.0),
    ("GLD", "SPDR Gold Shares", 1.0),
    ("IAU", "iShares Gold Trust", 1.0),
    ("SGOL", "Aberdeen Gold ETF", 1.0),
    ("GDX", "VanEck Gold Miners", 1.0),
]

# Symbol universes, with display colours.
METAL_FUNDS = ["GLD", "IAU", "SGOL", "GDX"]
MARKET_FUNDS = ["SPY", "QQQ", "VOO", "VTI", "DIA"]
ALL_FUNDS = METAL_FUNDS + MARKET_FUNDS
SYMBOL_COLORS = {
    "GLD": "#eab308",
    "IAU": "#f59e0b",
    "SGOL": "#d97706",
    "GDX": "#b45309",
    "SPY": "#3b82f6",
    "QQQ": "#8b5cf6",
    "VOO": "#06b6d4",
    "VTI": "#10b981",
    "DIA": "#ec4899",
    "GC=F": "#fbbf24",
}
DEFAULT_COLOR = "#9ca3af"

# Demand sources (key, name, percent, colour); percents add up to 100.
SOURCES = [
    ("institutional", "Institutional Investors", 35.0, "#3b82f6"),
    ("central_banks", "Central Banks", 22.0, "#eab308"),
    ("private_retail", "Private / Retail", 18.0, "#10b981"),
    ("jewelry", "Jewelry & Industrial", 15.0, "#f59e0b"),
    ("mining", "Mining & Supply", 10.0, "#8b5cf6"),
]

# Demand types and their colours.
DEMAND_COLORS = {
    "Central Bank": "#eab308",
    "Investment": "#3b82f6",
    "Jewelry": "#f59e0b",
    "Technology": "#8b5cf6",
    "Bars & Coins": "#10b981",
    "Mining": "#a855f7",
    "Refining": "#06b6d4",
    "Trading": "#6366f1",
}

# Regions (name, percent, colour), their countries (name, flag, percent) and demand by type in percent.
REGIONS = [
    ("Asia Pacific", 52.0, "#ef4444", [
        ("China", "🇨🇳", 24.0, {"Jewelry": 55.0, "Central Bank": 20.0, "Bars & Coins": 18.0, "Technology": 7.0}),
        ("India", "🇮🇳", 18.0, {"Jewelry": 65.0, "Bars & Coins": 20.0, "Central Bank": 10.0, "Technology": 5.0}),
        ("Thailand", "🇹🇭", 3.0, {"Jewelry": 60.0, "Bars & Coins": 40.0}),
        ("Japan", "🇯🇵", 2.5, {"Investment": 50.0, "Technology": 35.0, "Jewelry": 15.0}),
        ("South Korea", "🇰🇷", 1.5, {"Technology": 45.0, "Investment": 35.0, "Jewelry": 20.0}),
        ("Indonesia", "🇮🇩", 1.5, {"Jewelry": 70.0, "Bars & Coins": 30.0}),
        ("Vietnam", "🇻🇳", 1.5, {"Jewelry": 55.0, "Bars & Coins": 45.0}),
    ]),
    ("Europe", 22.0, "#3b82f6", [
        ("Turkey", "🇹🇷", 5.0, {"Jewelry": 40.0, "Central Bank": 35.0, "Bars & Coins": 25.0}),
        ("Germany", "🇩🇪", 4.0, {"Bars & Coins": 60.0, "Investment": 30.0, "Technology": 10.0}),
        ("United Kingdom", "🇬🇧", 4.0, {"Trading": 55.0, "Investment": 35.0, "Jewelry": 10.0}),
        ("Switzerland", "🇨🇭", 3.5, {"Refining": 50.0, "Investment": 35.0, "Jewelry": 15.0}),
        ("Poland", "🇵🇱", 2.5, {"Central Bank": 75.0, "Bars & Coins": 25.0}),
        ("France", "🇫🇷", 1.5, {"Investment": 50.0, "Jewelry": 30.0, "Technology": 20.0}),
        ("Czech Republic", "🇨🇿", 1.5, {"Central Bank": 85.0, "Investment": 15.0}),
    ]),
    ("Americas", 16.0, "#10b981", [
        ("United States", "🇺🇸", 10.0, {"Investment": 55.0, "Technology": 20.0, "Jewelry": 15.0, "Central Bank": 10.0}),
        ("Canada", "🇨🇦", 2.5, {"Mining": 50.0, "Investment": 40.0, "Jewelry": 10.0}),
        ("Brazil", "🇧🇷", 1.5, {"Jewelry": 45.0, "Investment": 35.0, "Central Bank": 20.0}),
        ("Mexico", "🇲🇽", 1.0, {"Jewelry": 50.0, "Bars & Coins": 35.0, "Mining": 15.0}),
        ("Peru", "🇵🇪", 1.0, {"Mining": 80.0, "Jewelry": 20.0}),
    ]),
    ("Middle East & Africa", 10.0, "#f59e0b", [
        ("Saudi Arabia", "🇸🇦", 2.5, {"Jewelry": 75.0, "Investment": 25.0}),
        ("UAE", "🇦🇪", 2.0, {"Jewelry": 50.0, "Trading": 35.0, "Investment": 15.0}),
        ("Egypt", "🇪🇬", 1.5, {"Jewelry": 60.0, "Bars & Coins": 30.0, "Central Bank": 10.0}),
        ("South Africa", "🇿🇦", 1.5, {"Mining": 70.0, "Jewelry": 20.0, "Investment": 10.0}),
        ("Ghana", "🇬🇭", 1.0, {"Mining": 85.0, "Jewelry": 15.0}),
        ("Iran", "🇮🇷", 1.5, {"Jewelry": 55.0, "Bars & Coins": 35.0, "Central Bank": 10.0}),
    ]),
]

# Market events (day, title, description); their order breaks ties.
EVENTS = [
    ("2024-01-31", "FOMC Holds Rates, Pushes Back on March Cut", "The Fed held rates at 5.25-5.50% and Chair Powell explicitly pushed back on a March rate cut, triggering repositioning across gold markets."),
    ("2024-03-20", "FOMC Holds, Signals Three 2024 Cuts", "The Federal Reserve held rates but maintained its projection of three rate cuts in 2024, sending gold surging past $2,200 for the first time."),
    ("2024-05-01", "FOMC Holds, Signals QT Taper", "The Fed held rates and announced it would slow the pace of balance sheet reduction starting in June, easing financial conditions and supporting gold."),
    ("2024-06-12", "CPI + FOMC Same-Day Double Event", "May CPI came in cooler than expected the same day the FOMC held rates with hawkish guidance reducing projected cuts to one, creating whipsaw volume in gold."),
    ("2024-07-31", "FOMC Holds, Hints at September Cut", "The Fed held rates but signaled a September cut was on the table, with Chair Powell noting inflation had moved closer to target."),
    ("2024-09-18", "Fed Cuts 50bp — First Cut Since 2020", "The Federal Reserve cut rates by 50 basis points to 4.75-5.00%, the first cut since March 2020 and larger than the 25bp most expected, supercharging gold."),
    ("2024-11-07", "Fed Cuts 25bp Post-Election", "The Fed cut rates by 25bp the day after the U.S. election, as markets digested the dual impact of monetary easing and a new administration."),
    ("2024-12-18", "Fed Cuts 25bp But Signals Fewer 2025 Cuts", "The Fed cut rates 25bp but the dot plot projected only two cuts in 2025 (down from four), shocking markets and driving heavy gold repositioning."),
    ("2024-01-11", "December CPI Hotter Than Expected", "December CPI came in at 3.4% vs. 3.2% expected, dampening rate-cut hopes and triggering heavy volume in gold futures."),
    ("2024-02-13", "January CPI Hotter Than Expected", "U.S. January CPI came in at 3.1% vs. 2.9% expected, dashing hopes for early Fed rate cuts and sparking heavy gold repositioning."),
    ("2024-03-12", "February CPI Slightly Hot", "February CPI at 3.2% exceeded the 3.1% forecast, reinforcing the Fed's cautious stance and driving gold volume as rate-cut timelines shifted."),
    ("2024-04-10", "March CPI Hotter Than Expected", "March CPI surprised to the upside at 3.5% vs. 3.4% expected, pushing back rate-cut expectations further and driving sharp gold repricing."),
    ("2024-05-15", "April CPI Shows Modest Cooling", "April CPI came in at 3.4%, in line with expectations and down from 3.5%, reviving hopes for a September rate cut and boosting gold."),
    ("2024-07-11", "June CPI Turns Negative Monthly", "June CPI showed the first monthly decline since 2020, dramatically boosting rate-cut expectations and driving heavy gold buying."),
    ("2024-08-14", "July CPI Confirms Disinflation Trend", "July CPI fell to 2.9%, the lowest since March 2021, cementing expectations for a September rate cut and supporting gold demand."),
    ("2024-09-11", "August CPI Slightly Above Expectations", "August core CPI ticked up to 0.3% monthly vs. 0.2% expected, tempering expectations for a jumbo Fed cut and creating gold volatility."),
    ("2024-10-10", "September CPI Slightly Hot", "September CPI at 2.4% came slightly above the 2.3% forecast, though the overall trend remained downward, driving gold volume."),
    ("2024-11-13", "October CPI In Line at 2.6%", "October CPI met expectations at 2.6%, maintaining the steady disinflation narrative and keeping December cut expectations intact."),
    ("2024-12-11", "November CPI at 2.7%", "November CPI ticked up to 2.7% as expected, keeping the Fed on track for a December cut but raising questions about the 2025 path."),
    ("2024-02-02", "January Jobs Blow Out at 353K", "January non-farm payrolls massively beat expectations at 353K vs. 180K forecast, pushing back rate-cut expectations and roiling gold markets."),
    ("2024-03-08", "February Jobs Report With Downward Revisions", "February payrolls came in at 275K but prior months were sharply revised down, fueling rate-cut bets and driving gold above $2,100."),
    ("2024-06-07", "May Jobs Surprisingly Strong", "May non-farm payrolls surged to 272K vs. 180K expected, temporarily denting gold as rate-cut expectations shifted further out."),
    ("2024-08-02", "Weak Jobs Report Sparks Recession Fears", "July non-farm payrolls came in at just 114K vs. 175K expected, triggering the Sahm Rule recession indicator and a flight to gold."),
    ("2024-10-04", "September Jobs Blowout — 254K", "September payrolls surged to 254K vs. 140K expected with upward revisions, dramatically reducing recession fears and whipsawing gold."),
    ("2024-04-15", "Iran-Israel Military Escalation", "Iran launched over 300 drones and missiles at Israel over the weekend. Markets opened Monday with a massive safe-haven rush into gold."),
    ("2024-08-05", "Global Market Crash — Yen Carry Trade Unwind", "The Japanese yen carry trade violently unwound, VIX spiked to 65, and global equities crashed. Gold saw massive safe-haven inflows."),
    ("2024-11-06", "U.S. Presidential Election — Trump Wins", "Donald Trump won the presidential election decisively. Gold saw extreme volume as traders repriced tariff, fiscal, and dollar expectations."),
    ("2024-05-20", "Gold Hits Record $2,450", "Gold broke through $2,450 for the first time, driven by persistent central bank buying and geopolitical uncertainty."),
    ("2024-10-30", "Gold Nears $2,800 Pre-Election", "Gold surged to nearly $2,800 as election uncertainty peaked, with traders hedging all outcomes ahead of the U.S. presidential vote."),
    ("2025-01-29", "FOMC Holds Rates at 4.25-4.50%", "The Fed held rates steady at the first meeting of 2025, citing continued progress on inflation but maintaining a cautious approach amid tariff uncertainty."),
    ("2025-03-19", "FOMC Holds, Cites Tariff Uncertainty", "The Fed held rates and Chair Powell said the committee is focused on \"separating signal from noise\" as tariff policy clouds the economic outlook."),
    ("2025-05-07", "FOMC Holds Amid Tariff-Driven Inflation Fears", "The Fed held rates steady, citing that \"uncertainty about the economic outlook has increased further\" with risks of both higher unemployment and inflation."),
    ("2025-05-28", "FOMC Minutes Warn of Tariff-Inflation Tradeoffs", "The release of May FOMC minutes revealed the Fed warning it \"could face difficult tradeoffs if tariffs reaggravate inflation,\" rattling gold markets."),
    ("2025-06-18", "FOMC Holds, Signals Patience on Cuts", "The Fed kept rates unchanged and signaled it would remain patient before cutting, as tariff impacts on prices remained uncertain."),
    ("2025-07-30", "Fed Cuts 25bp as Economy Slows", "The Fed cut rates by 25bp as economic data showed the impact of trade restrictions, marking the first easing move of 2025 and boosting gold."),
    ("2025-09-17", "Fed Cuts 25bp Again", "The Fed delivered another 25bp cut as inflation continued moderating, pushing rates to 3.75-4.00% and supporting gold's ongoing rally."),
    ("2025-10-29", "FOMC Holds, Assesses Cumulative Cuts", "The Fed paused rate cuts to assess the impact of prior easing, with markets debating whether more cuts would come in December."),
    ("2025-12-10", "Fed Cuts 25bp, Projects More Easing in 2026", "The Fed cut rates to 3.50-3.75% and the dot plot projected continued easing into 2026, fueling gold's year-end surge past $4,500."),
    ("2025-01-20", "Trump Inauguration — Executive Orders on Trade", "President Trump was inaugurated and signed a wave of executive orders on trade and tariffs, triggering uncertainty-driven gold volume."),
    ("2025-02-04", "New Tariffs Take Effect on China", "A 10% tariff on Chinese imports took effect while Mexico and Canada tariffs were delayed after last-minute negotiations, roiling commodity markets."),
    ("2025-03-04", "Tariffs on China Double to 20%", "The U.S. doubled tariffs on China to 20% and imposed 25% on Canada and Mexico, escalating trade war fears and driving gold demand."),
    ("2025-03-27", "Auto Tariffs Announced — 25% on All Imports", "President Trump announced 25% tariffs on all imported automobiles and auto parts, broadening trade tensions and pushing gold higher as consumer confidence hit a 12-year low."),
    ("2025-04-02", "\"Liberation Day\" — Sweeping Tariffs Announced", "President Trump announced sweeping reciprocal tariffs on nearly all trading partners, triggering the largest single-day gold volume spike in months."),
    ("2025-04-09", "90-Day Tariff Pause — Massive Relief Rally", "Trump paused most reciprocal tariffs for 90 days (except China, raised to 145%). Markets whipsawed with record volume as traders unwound hedges."),
    ("2025-03-14", "Gold Breaks $3,000 for First Time", "Gold crossed the historic $3,000/oz milestone for the first time, fueled by central bank accumulation, trade war fears, and dollar weakness."),
    ("2025-04-22", "Gold Hits $3,500 as Dollar Slides", "Gold surged past $3,500/oz as the U.S. dollar weakened sharply on concerns over Fed independence and escalating trade tensions with China."),
    ("2025-10-07", "Gold Breaks $4,000 — U.S. Shutdown Fears", "Gold smashed through $4,000/oz for the first time as a looming U.S. government shutdown added fuel to a rally driven by rate cuts, central bank buying, and dollar weakness."),
    ("2025-12-24", "Gold Tops $4,500 on Geopolitical Tensions", "Gold surged past $4,500/oz for the first time amid escalating Venezuela tensions and broad dollar weakness, capping a year with 70%+ gains."),
    ("2025-11-25", "Fed Governor Waller Backs December Rate Cut", "Fed Governor Christopher Waller publicly backed a December rate cut, sending gold above $4,100 as the dollar weakened on rising easing expectations."),
    ("2026-01-28", "FOMC Holds + Gold Hits $5,589 All-Time High", "The Fed held rates at 3.50-3.75% as gold surged over $300 in a single day to a record $5,589/oz, driven by escalating U.S.-Iran tensions and record ETF inflows of $19B for the month."),
    ("2026-01-29", "Gold Crashes $380 in 28 Minutes", "Gold plunged $380 (nearly 7%) in just 28 minutes as profit-taking and algorithmic selling hit after the record high, with the metal falling from near $5,600."),
    ("2026-01-30", "Kevin Warsh Nominated as Fed Chair — Metals Crash", "Trump announced Kevin Warsh as next Federal Reserve Chair. Gold crashed over 10% and silver plunged 30% in the biggest precious metals selloff since the 1980s as markets repriced rate expectations."),
]
DEFAULT_EVENT = (
    "Unusual Volume Spike",
    "Trading volume significantly exceeded the historical average for this period.",
)
