"""Place names, names in two scripts, and other word lists as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import place_text

#: Governorate, English name, accepted spellings, districts in order. One stands twice with
#: different districts; both count.
GOVERNORATES = [
    ("صنعاء", "Sana'a", ("صنعاء", "صنعا", "أمانة العاصمة"), ("بني الحارث", "معين", "الثورة", "التحرير", "الصافية", "شعوب", "السبعين", "الوحدة", "آزال", "صنعاء القديمة")),
    ("عدن", "Aden", ("عدن",), ("كريتر", "المعلا", "التواهي", "صيرة", "الشيخ عثمان", "المنصورة", "دار سعد", "البريقة")),
    ("تعز", "Taiz", ("تعز",), ("القاهرة", "المظفر", "صالة", "الشمايتين", "الوازعية", "جبل حبشي", "المواسط", "الصلو")),
    ("الحديدة", "Hodeidah", ("الحديدة", "الحديده", "حديدة"), ("الحديدة", "باجل", "زبيد", "اللحية", "الزهرة", "الزيدية", "الحوك", "بيت الفقيه")),
    ("إب", "Ibb", ("إب", "اب"), ("إب", "جبلة", "ذي السفال", "يريم", "النادرة", "السياني", "العدين", "بعدان")),
    ("ذمار", "Dhamar", ("ذمار",), ("ذمار", "عنس", "جهران", "مغرب عنس", "عتمة", "وصاب السافل", "الحدا")),
    ("حضرموت", "Hadramaut", ("حضرموت", "حضرموت"), ("المكلا", "سيئون", "شبام", "تريم", "الشحر", "ساه", "القطن", "دوعن", "غيل باوزير")),
    ("المحويت", "Al Mahwit", ("المحويت", "محويت"), ("المحويت", "الرجم", "حفاش", "شبام كوكبان", "ملحان", "بني سعد")),
    ("صعدة", "Saada", ("صعدة", "صعده"), ("صعدة", "حيدان", "رازح", "البقع", "كتاف", "منبه", "قطابر")),
    ("عمران", "Amran", ("عمران",), ("عمران", "خمر", "حرف سفيان", "ثلا", "رداع", "سحار")),
    ("الجوف", "Al Jawf", ("الجوف", "جوف"), ("الحزم", "الغيل", "برط العنان", "خب والشعف", "المتون", "المصلوب")),
    ("حجة", "Hajjah", ("حجة", "حجه"), ("حجة", "عبس", "قارة", "كحلان عفار", "مبين", "حرض", "ميدي", "كشر")),
    ("لحج", "Lahij", ("لحج", "لحي"), ("الحوطة", "تبن", "يافع", "يهر", "الحد", "المفلحي", "الملاح")),
    ("مأرب", "Marib", ("مأرب", "مارب"), ("مأرب", "حريب", "صرواح", "مدغل", "رحبة", "الجوبة")),
    ("ريمة", "Raymah", ("ريمة", "ريمه"), ("الجبين", "كسمة", "السلفية", "بلاد الطعام", "الجعفرية", "مزهر")),
    ("أبين", "Abyan", ("أبين", "ابين"), ("زنجبار", "جعار", "لودر", "أحور", "المحفد", "سباح")),
    ("البيضاء", "Al Bayda", ("البيضاء", "بيضاء"), ("البيضاء", "رداع", "السوادية", "قيفة", "ذي ناعم", "مكيراس")),
    ("المهرة", "Al Mahrah", ("المهرة", "مهرة"), ("الغيضة", "سيحوت", "حصوين", "قشن", "شحن", "حات")),
    ("شبوة", "Shabwah", ("شبوة", "شبوه"), ("عتق", "حبان", "عرما", "بيحان", "الروضة", "ميفع", "رضوم")),
    ("الضالع", "Al Dhale'e", ("الضالع", "ضالع"), ("الضالع", "قعطبة", "جبن", "دمت", "الحشاء", "الأزارق")),
    ("سقطرى", "Socotra", ("سقطرى", "سقطري"), ("حديبو", "قلنسيه", "عبد الكوري", "مومي")),
    ("الحديدة", "Hodeidah", ("الحديدة", "حديدة"), ("الحديدة", "باجل", "زبيد", "اللحية", "الزهرة", "المنيرة")),
]
#: Arabic names and their usual English form.
NAMES = {
    "محمد": "Mohammed", "أحمد": "Ahmed", "علي": "Ali", "عبدالله": "Abdullah", "عبد الله": "Abdullah", "خالد": "Khaled", "عمر": "Omar",
    "يوسف": "Youssef", "إبراهيم": "Ibrahim", "ابراهيم": "Ibrahim", "حسن": "Hassan", "حسين": "Hussein", "سعيد": "Saeed", "سالم": "Salem",
    "ناصر": "Nasser", "صالح": "Saleh", "فهد": "Fahd", "سلطان": "Sultan", "ماجد": "Majed", "فيصل": "Faisal", "طارق": "Tariq", "زيد": "Zaid",
    "عادل": "Adel", "سامي": "Sami", "وليد": "Waleed", "رشيد": "Rashid", "جمال": "Jamal", "كريم": "Kareem", "مصطفى": "Mustafa", "قصي": "Qusai",
    "نادر": "Nader", "جابر": "Jaber", "عبدالجبار": "Abduljabbar", "عبدالحميد": "Abdulhamid", "عبده": "Abdo", "رماح": "Ramah", "رمـاح": "Ramah",
    "عبدالرحمن": "Abdulrahman", "عبد الرحمن": "Abdulrahman", "عبدالعزيز": "Abdulaziz", "عبد العزيز": "Abdulaziz", "فاطمة": "Fatima",
    "عائشة": "Aisha", "مريم": "Maryam", "زينب": "Zainab", "خديجة": "Khadija", "نور": "Noor", "سارة": "Sarah", "ليلى": "Layla", "هدى": "Huda",
    "سلمى": "Salma", "أمل": "Amal", "منى": "Mona", "رانيا": "Rania", "دينا": "Dina", "نادية": "Nadia", "سناء": "Sanaa", "هناء": "Hanaa",
    "جميلة": "Jamila", "كريمة": "Karima", "حليمة": "Halima", "آمنة": "Amina", "امنة": "Amina", "رقية": "Ruqaya", "سمية": "Sumaya",
    "عفاف": "Afaf", "نجاة": "Najat", "سميرة": "Samira", "سماح": "Samah", "الحسني": "Al-Hasani", "الأحمدي": "Al-Ahmadi", "العمري": "Al-Omari",
    "الصالحي": "Al-Salehi", "المحمدي": "Al-Mohammadi", "القحطاني": "Al-Qahtani", "الغامدي": "Al-Ghamdi", "الزهراني": "Al-Zahrani",
    "الشهري": "Al-Shehri", "الدوسري": "Al-Dosari",
}
#: English spellings in order of preference.
SPELLINGS = (
    "Mohammed", "Muhammad", "Mohamed", "Ahmad", "Ahmed", "Ali", "Abdullah", "Khaled", "Khalid", "Omar", "Umar", "Youssef", "Yousef", "Joseph",
    "Ibrahim", "Abraham", "Hassan", "Hasan", "Hussein", "Hussain", "Saeed", "Said", "Salem", "Salim", "Nasser", "Nasir", "Saleh", "Salih", "Fahd",
    "Fahad", "Sultan", "Majed", "Majid", "Faisal", "Faysal", "Tariq", "Tarek", "Zaid", "Zayd", "Adel", "Adil", "Sami", "Sammy", "Waleed", "Walid",
    "Rashid", "Rasheed", "Jamal", "Kamal", "Kareem", "Karim", "Mustafa", "Mustapha", "Fatima", "Fatimah", "Aisha", "Aysha", "Maryam", "Mariam",
    "Mary", "Zainab", "Zaynab", "Khadija", "Khadijah", "Noor", "Nour", "Nur", "Sarah", "Sara", "Layla", "Leila", "Laila", "Huda", "Houda", "Salma",
    "Selma", "Amal", "Amaal", "Mona", "Muna", "Rania", "Raniya", "Dina", "Deena", "Nadia", "Nadya", "Sanaa", "Sana", "Hanaa", "Hana", "Jamila",
    "Jameela", "Karima", "Kareema", "Halima", "Haleema", "Amina", "Aminah", "Ameena", "Ruqaya", "Ruqayyah", "Sumaya", "Sumayyah", "Afaf", "Najat",
    "Najaat", "Samira", "Sameera",
)
#: English words that are no names.
COMMON_WORDS = (
    "light", "moon", "star", "sun", "sky", "flower", "rose", "pearl", "beautiful", "beauty", "pretty", "handsome", "kind", "generous", "lion",
    "tiger", "eagle", "falcon", "hawk", "happiness", "happy", "joy", "hope", "faith", "peace", "noble", "precious", "beloved", "dear", "sweet",
    "gift", "blessing", "fortune", "luck", "victory", "river", "sea", "ocean", "mountain", "garden", "paradise", "gold", "silver", "diamond", "ruby",
    "emerald", "king", "queen", "prince", "princess", "leader",
)


def governorates(spark: SparkSession, normalised: bool = True) -> DataFrame:
    """``token``, ``governorate``: every accepted spelling, the first governorate of each."""
    rows = [(i, name, token) for i, (name, _, variants, _) in enumerate(GOVERNORATES) for token in {name, *variants}]
    return _first(spark.createDataFrame(rows, "ord int, governorate string, token string"), normalised)


def districts(spark: SparkSession, normalised: bool = True) -> DataFrame:
    """``token``, ``governorate``: every district, the first governorate of each."""
    rows = [(i, name, d) for i, (name, _, _, parts) in enumerate(GOVERNORATES) for d in parts]
    return _first(spark.createDataFrame(rows, "ord int, governorate string, token string"), normalised)


def _first(df: DataFrame, normalised: bool) -> DataFrame:
    token = place_text(F.col("token")) if normalised else F.col("token")
    return df.groupBy(token.alias("token")).agg(F.min_by("governorate", "ord").alias("governorate"))


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES.items()), "arabic string, english string")


def spellings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPELLINGS)), "ord int, name string")


def common_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in COMMON_WORDS], "word string")
