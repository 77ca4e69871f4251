"""The fixed texts of reports, held literally here: the SQL of the queries is built from the library's own tables."""

from decimal import Decimal

from basketlens.operators import customers, products, rfm
from tests import fixtures
from tests.fixtures import rows

BY_AGE = {
    ("18-29", "Social media marketing, mobile payment promotions, youth-exclusive discounts"),
    ("30-39", "Family packages, credit card reward points, convenient payment experience"),
    ("40-49", "Quality assurance, membership privileges, diverse payment options"),
    ("50-59", "Traditional channel promotion, large discounts, credit payment promotion"),
    ("60+", "Simple and easy-to-use payment methods, offline events, attentive service"),
}


def test_age_band_strategies(spark):
    people = fixtures.customers(spark, [(f"C{a}", "F", a, "Cash") for a in (18, 29, 30, 39, 40, 49, 50, 59, 60, 95)])
    profile = customers.age_band_profile(people)
    assert rows(profile, "age_band", "strategy") == BY_AGE
    assert {r["customers"] for r in profile.collect()} == {2}


def test_price_band_characters(spark):
    goods = fixtures.products(spark, [(f"P{i}", "Toys", p) for i, p in enumerate((0, 19.99, 20, 49.99, 50, 99.99, 100, 199.99, 200, 5000))])
    assert rows(products.price_band_top_categories(goods), "price_band", "characteristics", "products") == {
        ("0-20", "Budget products, high volume potential", 2),
        ("20-50", "Value segment, competitive pricing", 2),
        ("50-100", "Mid-market, quality focus", 2),
        ("100-200", "Premium products, feature-rich", 2),
        ("200+", "High-end products, exclusive market", 2),
    }


def test_category_strategies(spark):
    goods = fixtures.products(spark, [(f"P{i}", f"c{p}", p) for i, p in enumerate((29.99, 30, 79.99, 80, 149.99, 150))])
    assert rows(products.category_strategy(goods), "category", "tier", "strategy") == {
        ("c29.99", "Economy", "Economy segment - focus on volume sales, bundle offers"),
        ("c30", "Mid-range", "Mid-range segment - balance quality and affordability"),
        ("c79.99", "Mid-range", "Mid-range segment - balance quality and affordability"),
        ("c80", "Premium", "Premium segment - emphasize quality and features"),
        ("c149.99", "Premium", "Premium segment - emphasize quality and features"),
        ("c150", "Luxury", "Luxury segment - focus on exclusivity and premium experience"),
    }


def test_segment_playbook(spark):
    names = ("High Value", "Regular", "At Risk", "New/Low Activity")
    segmented = spark.createDataFrame([(n, Decimal(1)) for n in names for _ in range(2)] + [(None, Decimal(1))], "segment string, monetary decimal(12,2)")
    book = rfm.segment_playbook(segmented)
    assert rows(book, "segment", "customers", "characteristics") == {
        ("High Value", 2, "High spending, frequent purchases, recent activity"),
        ("Regular", 2, "Moderate spending and frequency, stable activity"),
        ("At Risk", 2, "Long time since last purchase, potential churn"),
        ("New/Low Activity", 2, "Low spending, infrequent purchases, or new customers"),
    }
    steps = {
        "High Value": ("VIP treatment with exclusive offers", "Personalized product recommendations", "Loyalty program with premium benefits",
                       "Early access to new products", "Dedicated customer service"),
        "Regular": ("Cross-selling and up-selling opportunities", "Moderate loyalty rewards", "Seasonal promotions", "Product bundle offers",
                    "Email marketing with personalized content"),
        "At Risk": ("Win-back campaigns with special discounts", "Re-engagement emails", "Survey to understand reasons for inactivity",
                    "Limited-time exclusive offers", "Personalized we miss you messages"),
        "New/Low Activity": ("Welcome series for new customers", "Educational content about products", "Small incentive for second purchase",
                             "Simple loyalty program introduction", "Social proof and testimonials"),
    }
    assert rows(book, "segment", "step", "recommendation") == {(n, i, text) for n in names for i, text in enumerate(steps[n], 1)}
