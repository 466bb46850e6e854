"""Words, texts and pages with the results that must come out (fixed values)."""

# word=stem; a word alone stays as it is.
STEMS = (
    "бегающий=бега бегающая=бега бегающее=бега бегать=бега бегаю=бега бегает=бега бегали=бега дом дома=дом дому=дом домом=дом домами=дом "
    "красивый=красив красивая=красив красивое=красив красивыми=красив красивейший=красив бегавший=бега убежав=убежа сделанный=сдела "
    "кардиомиопатия=кардиомиопат кардиомиопатии=кардиомиопат кардиомиопатий=кардиомиопат гипертензия=гипертенз гипертензии=гипертенз артериосклероз остеохондроз головокружение=головокружен головокружения=головокружен "
    "COVID-19 SARS-CoV-2 MRI CT ВИЧ-инфекция=вич-инфекц СПИД-ассоциированный=спид-ассоциирова computer programming algorithm database software development "
    "ибупрофен=ибупроф парацетамол амитриптилин метилпреднизолон ацетилсалициловая=ацетилсалицилов респираторная=респираторн "
    "ёлка=елк ёлочка=елочк пёстрый=пестр лёгочный=легочн сердцёбиение=сердцебиен я он мы врч кгб ВИЧ ОРИ HIV AIDS PCR DNA RNA "
    "аппендэктомия=аппендэктом лапароскопия=лапароскоп рентгенография=рентгенограф ультразвуковое=ультразвуков антибиотикотерапия=антибиотикотерап антикоагулянты=антикоагулянт "
    "кардиологическое=кардиологическ обследование=обследован проведенное=проведен вчера=вчер выявило=выяв признаки=признак ишемической=ишемическ болезни=болезн сердца=сердц "
    "лежащая=леж лежащий=лежащ бегающими=бегающ говоривший=говоривш состав=соста мотив=мот"
)

# Texts and their tokens.
TOKENS = (
    ("Принимать по одной таблетке", "принимать по одной таблетке"),
    ("Вводить в/м или в/в по показаниям", "вводить в/м или в/в по показаниям"),
    ("5-НОК и бета-каротин с омега-3 кислотами", "5-нок и бета-каротин с омега-3 кислотами"),
    ("Витамины C, D3, B12, PP, K1, B1", "витамины C D3 B12 PP K1 B1"),
    ("Температура 15–30 °C, диапазон 10-20 мг", "температура °C диапазон 10-20 мг"),
    ("pH 7.2-7.4, концентрация 0.9% NaCl", "ph 7.2-7.4 концентрация nacl"),
    ("Хранить при 15–30 °C, не выше 25°C", "хранить при °C не выше 25°C"),
    ("альфа-линоленовая кислота и бета-каротин", "альфа-линоленовая кислота и бета-каротин"),
    ("Принимать по 100 мг 2 раза в день, 5 мл суспензии", "принимать по мг раза в день мл суспензии"),
    ("Vitamin C (аскорбиновая кислота) и Omega-3", "vitamin C аскорбиновая кислота и"),
    ("Принимать: утром и вечером! После еды? Да, обязательно.", "принимать утром и вечером после еды да обязательно"),
    ("Раствор 0.9% натрия хлорида, 5% глюкоза", "раствор натрия хлорида 5% глюкоза"),
    ("", ""),
    ("   \t\n  ", ""),
    ("!!! ??? ... ,,, ;;", ""),
    ("орто-фенилфенол и мета-ксиленол изо-пропил", "орто-фенилфенол и мета-ксиленол изо-пропил"),
    (
        "Каопектат®: суспензия 15 мл содержит 750 мг аттапульгита. Применять в/м по 100 мг витамина C и D3. Хранить при 15–30 °C. pH 7.2-7.4, концентрация",
        "каопектат® суспензия мл содержит мг аттапульгита применять в/м по мг витамина C и D3 хранить при °C ph 7.2-7.4 концентрация",
    ),
    ("пре- и постоперационный период, анти-В-клеточный", "и постоперационный период"),
    ("Таблетки №10, капсулы 100 мг, ампулы 2 мл", "таблетки капсулы мг ампулы мл"),
    ("Ёлка A a % / – «Слово» 25°CABC мг/25°cX 10-20°C x-ray T-shirt-size COVID-19 site.com 100 H2O b12 + -", "йлка A a % / – «слово» 25°CABC мг/25°C 10-20°C x-ray"),
)

# Parser, page, text and links.
PAGES = (
    (
        "rlsnet",
        '<html><head><title>T</title><script type="application/ld+json">{"headline":"Аспирин","articleBody":"Текст статьи"}</script></head><body><h2 class="structure-heading">Фармакология</h2><div><a href="/x">Анальгетик</a><a href="/y">НПВС</a></div></body></html>',
        "Аспирин\nТекст статьи\nФармакология: Анальгетик; НПВС",
        "https://e.ru/x https://e.ru/y",
    ),
    (
        "isgeotar",
        '<html><head><title>Аспирин - Информация о препарате - ЛС ГЭОТАР</title></head><body><div><div data-test-id="mnn-label">МНН</div><div data-test-id="mnn-content">Ацетилсалициловая кислота</div></div><div><div data-test-id="form-label">Форма</div><div data-test-id="form-content">Таблетки</div></div><a href="/drugs/2">x</a></body></html>',
        "Аспирин\nМНН: Ацетилсалициловая кислота\nФорма: Таблетки",
        "https://e.ru/drugs/2",
    ),
)


def stems() -> list[tuple[str, str]]:
    return [(w, s or w) for w, _, s in (x.partition("=") for x in STEMS.split())]
