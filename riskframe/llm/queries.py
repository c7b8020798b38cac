"""The operators' queries and, where SQL can say the same, their SQL."""

from riskframe.llm import attention, centroids, decontaminate, htmltext, lm, mixing, pseudonyms, quality, secrets, simhash, substrings, turntrie, urlrules

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_substrings": substrings.query,
    "op3_htmltext": htmltext.query,
    "op4_secrets": secrets.query,
    "op5_pseudonyms": pseudonyms.query,
    "op6_urlrules": urlrules.query,
    "op7_mix": mixing.query,
    "op8_simhash": simhash.query,
    "op9_quality": quality.query,
    "op10_lm": lm.query,
    "op11_turntrie": turntrie.query,
    "op12_centroids": centroids.query,
    "op13_attention": attention.query,
}
ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_substrings": substrings.ORACLE,
    "op7_mix": mixing.ORACLE,
    "op11_turntrie": turntrie.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
