"""Compare registered queries with their checking SQL: python tests/compare_oracles.py sf0.01 [pattern ...]"""
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from docassay.session import build_session
import __spark_entry__ as E
sf=sys.argv[1]; pats=sys.argv[2:]
d=f'/root/testdata/{sf}'
s=build_session(master=os.environ.get('MASTER','local[8]'),shuffle=8); s.sparkContext.setLogLevel('ERROR')
c=duckdb.connect()
for t in 'region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations'.split():
    c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
Q=E.queries(); O=E.oracle_sql()
def norm(v):
    if v is None: return None
    if isinstance(v,float):
        if math.isnan(v): return None
        return round(v,6)+0.0
    if isinstance(v,bool) or isinstance(v,str): return v
    import numpy as np
    if isinstance(v,(np.bool_,)): return bool(v)
    if isinstance(v,(int,np.integer)): return float(v)
    if isinstance(v,(np.floating,)): return None if np.isnan(v) else round(float(v),6)+0.0
    return str(v)
def rows(cols,data):
    o=sorted(range(len(cols)),key=lambda i:cols[i])
    return sorted([tuple(norm(r[i]) for i in o) for r in data],key=repr),[cols[i] for i in o]
ok=bad=0
for k,f in Q.items():
    if pats and not any(re.search(p,k) for p in pats): continue
    t=time.time()
    try:
        df=f(s,d); sr=[tuple(r) for r in df.collect()]; a,ca=rows(df.columns,sr); ts=time.time()-t
    except Exception as e:
        print('FAIL',k,'spark',str(e)[:400],flush=True); bad+=1; continue
    if k not in O: print('  --',k,len(a),round(ts,2)); continue
    try:
        t=time.time(); r=c.sql(O[k]); dr=r.fetchall(); b,cb=rows(r.columns,dr); td=time.time()-t
    except Exception as e:
        print('FAIL',k,'duck',str(e)[:500]); bad+=1; continue
    st={x[0]:x[1] for x in df.dtypes}
    if ca!=cb: print('FAIL',k,'cols',ca,cb); bad+=1; continue
    dd=[(x,y) for x,y in zip(a,b) if x!=y]
    if len(a)!=len(b) or dd:
        print('FAIL',k,len(a),len(b),ca); 
        sa,sb=set(a),set(b)
        print('   spark only',list(sa-sb)[:3]); print('   duck only ',list(sb-sa)[:3]); bad+=1
    else:
        from decimal import Decimal
        types=dict(zip(r.columns,[str(x) for x in r.types]))
        odd=[(n,st[n],types[n]) for n in st if {'string':'VARCHAR','bigint':'BIGINT','int':'INTEGER','double':'DOUBLE','boolean':'BOOLEAN'}.get(st[n])!=types[n]]
        nul=[n for i,n in enumerate(ca) if any(x[i] is None for x in a)]
        ok+=1; print('ok',k,len(a),'spark',round(ts,2),'duck',round(td,2),'TYPES' if odd else '',odd or '','NULLS '+str(nul) if nul else '')
print('ok',ok,'bad',bad)
